"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulant.llm.shared import BLANKS, components, python_ready
from tabulant.storage import stored

#: Words to a shingle and the share of shared shingles that links, unless a caller says otherwise.
WORDS, SIMILARITY = 5, 80
#: Positions of a signature.
POSITIONS = 140
#: Chance that a pair at the threshold shares no band, at most.
MISS = 1e-6
#: Members of a bucket that one task compares at a time.
BLOCK = 400
#: Sets that one is compared with before what is connected is looked at again.
TOGETHER = 64
#: Standard errors of the signature's estimate below the threshold from which a pair is left out.
SIGMAS = 5.0
#: Bytes of text hashed at a time.
PIECE = 1 << 18
#: Elements whose shuffles are held at a time.
ELEMENTS = 60_000

U8, U64 = np.uint8, np.uint64


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers: a bijection whose output looks random (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mixed_bits(np.arange(1, 257, dtype=U64))
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_STEP = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_POWERS = np.cumprod(np.full(PIECE * 2, _STEP, U64))
_BACK = np.cumprod(np.full(PIECE * 2, pow(_STEP, -1, 1 << 64), U64))


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash for each word of a text given as UTF-8 bytes, with A-Z as a-z.

    A word's hash is a sum of its bytes' values times powers of one odd number; a prefix sum over
    the piece and the inverse power at the word's start make it the same wherever the word stands.
    """
    blank = _BLANK[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    found, first = [], 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if ends[last - 1] - base > len(_POWERS):  # one word longer than a piece: summed by itself
            word, total = text[base : ends[last - 1]], U64(0)
            for at in range(0, len(word), PIECE):
                part = mixed_bits((_BYTES[word[at : at + PIECE]] * _POWERS[: len(word[at : at + PIECE])]).sum(dtype=U64) + U64(at))
                total = mixed_bits(total + part)
            found.append(np.array([total + U64(len(word))], U64))
        else:
            sums = np.zeros(ends[last - 1] - base + 1, U64)
            np.cumsum(_BYTES[text[base : ends[last - 1]]] * _POWERS[: len(sums) - 1], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            found.append((sums[e] - sums[s]) * _BACK[s] + (e - s).astype(U64))
        first = last
    return mixed_bits(np.concatenate(found)) if found else np.zeros(0, U64)


def shingles(text: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``words`` words; fewer words are one run."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    runs = max(1, len(hashes) - words + 1)
    out = np.full(runs, min(words, len(hashes)), U64)
    for k in range(min(words, len(hashes))):
        out = mixed_bits(out * U64(_STEP) + hashes[k : k + runs])
    return np.unique(out)


def signatures(values: np.ndarray, lengths: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """SuperMinHash of many sets at once: ``values`` holds their elements one set after another.

    Every element walks through the positions in an order of its own, a shuffle made as it goes,
    and offers at its j-th step the value j plus a random fraction. A position keeps the least offer.
    As steps outrank fractions, a position that is filled is settled, and a set is done as
    soon as all are. Values are integers, the step in the top byte.
    """
    sets, free = len(lengths), ~U64(0)
    best = np.full((sets, positions), free, U64)
    owner = np.repeat(np.arange(sets), lengths)
    order = np.tile(np.arange(positions, dtype=U8), (len(values), 1))
    at, seeds = np.arange(len(values)), values
    for step in range(positions):
        draw = mixed_bits(seeds + U64((step + 1) * _STEP % (1 << 64)))
        pick = step + (((draw >> U64(40)) * U64(positions - step)) >> U64(24)).astype(np.int64)
        place = order[at, pick]
        order[at, pick] = order[at, step]
        open_ = best[owner, place] == free
        offers = (mixed_bits(draw) >> U64(8)) | (U64(step) << U64(56))
        np.minimum.at(best, (owner[open_], place[open_]), offers[open_])
        going = (best == free).any(axis=1)[owner]
        if not going.any():
            break
        if going.mean() < 0.7:
            at, seeds, owner = at[going], seeds[going], owner[going]
    return best


def banding(similarity: int, positions: int, miss: float) -> tuple[int, int]:
    """Rows to a band, as many as keep the chance to miss a pair at the threshold low, and bands."""
    for rows in range(8, 1, -1):
        if (1 - (similarity / 100) ** rows) ** (positions // rows) <= miss:
            return rows, positions // rows
    return 1, positions


def texts_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Each text of a batch's ``text`` column as bytes; a null has none."""
    column = batch.column("text")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", U8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield data[offsets[k] : offsets[k + 1]] if valid[k] else data[:0]


def sketch_rows(words: int, positions: int, rows: int, bands: int):
    """For mapInArrow: id, set size, set identity, band keys and the signature's low bytes."""

    def flush(ids: list, hashes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in sets], np.int64)
        some = lengths > 0
        best = np.zeros((len(sets), positions), U64)
        small = some & (lengths <= ELEMENTS)
        if small.any():
            best[small] = signatures(np.concatenate([s for s, one in zip(sets, small) if one]), lengths[small], positions)
        for k in np.flatnonzero(lengths > ELEMENTS):  # a minimum over parts is that over all
            parts = np.array_split(sets[k], -(-lengths[k] // ELEMENTS))
            best[k] = np.min([signatures(p, np.array([len(p)]), positions)[0] for p in parts], axis=0)
        keys = np.full((len(sets), bands), 1, U64) * np.arange(1, bands + 1, dtype=U64)
        for k in range(rows):
            keys = mixed_bits(keys * U64(_STEP) + best[:, k : rows * bands : rows])
        one = np.array([s.sum(dtype=U64) for s in sets], U64)
        two = np.array([mixed_bits(s ^ U64(_STEP)).sum(dtype=U64) for s in sets], U64)
        low = pa.array([row.tobytes() for row in best.astype(U8)], pa.binary())
        flat = pa.array(keys.reshape(-1).view(np.int64))
        offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(lengths), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
             pa.ListArray.from_arrays(offsets, flat), low],
            ["doc_id", "text_hash", "n_shingles", "set_one", "set_two", "bands", "low"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sets, held = [], [], [], 0
        for batch in batches:
            known = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch))
            for doc_id, text_hash, text in known:
                found = shingles(text, words)
                if sets and held + len(found) > ELEMENTS:
                    yield flush(ids, hashes, sets)
                    ids, hashes, sets, held = [], [], [], 0
                ids.append(doc_id)
                hashes.append(text_hash)
                sets.append(found)
                held += len(found)
        if sets:
            yield flush(ids, hashes, sets)

    return run


def set_rows(words: int):
    """For mapInArrow: id and the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words).view(np.int64) for text in texts_of(batch)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["node", "members"])

    return run


def linked_rows(similarity: int):
    """For mapInArrow: of pairs with both sets, those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("set_a", "set_b"):
                lists = batch.column(name)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)))
            (oa, va), (ob, vb) = sides
            keep = []
            for k in range(batch.num_rows):
                a, b = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                keep.append(100 * common >= similarity * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of some sorted sets shares with one."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    ends = np.cumsum([len(o) for o in others])
    hits = np.concatenate(([0], np.cumsum(own[at] == flat)))
    return hits[ends] - hits[ends - [len(o) for o in others]]


def links_of_block(similarity: int, positions: int):
    """For applyInArrow: links between components, confirmed on full sets, in one block of a bucket.

    Two signatures of sets with similarity J agree in a share of positions near J (a little more, as
    only bytes are compared); pairs far below the threshold are left out. A pair that shares several
    buckets is compared in the first of them, since buckets of nodes that are not connected are all
    open. Members that become connected on the way are not compared with each other any more.
    """
    share = similarity / 100
    floor = (share - SIGMAS * (share * (1 - share) / positions) ** 0.5) * positions

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        node, root, shared, stray = column("node"), column("root").copy(), column("shared"), column("stray")
        keys = table.column("bands").combine_chunks().values.to_numpy().reshape(len(node), -1)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), U8).reshape(-1, positions)
        lists = table.column("members").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
        size = np.diff(offsets)
        bucket = table.column("bucket")[0].as_py()
        answer = np.flatnonzero(column("answers"))
        links = []
        for k in np.flatnonzero(column("asks")):
            # Exact: two sets have no more in common than the smaller one's elements that others have too.
            most = np.minimum(shared[answer], shared[k])
            fits = 100 * most >= similarity * (size[answer] + size[k] - most)
            there = answer[fits & (root[answer] != root[k])]
            there = there[~stray[there] | (node[there] < node[k])]  # of two that ask, one is enough
            # An id with several texts may stand here by the bands of another one.
            earlier = int(np.argmax(keys[k] == bucket))
            there = there[~(keys[there, :earlier] == keys[k, :earlier]).any(axis=1)]
            near = (low[there] == low[k]).sum(axis=1)
            there = there[np.argsort(-near, kind="stable")][: int((near >= floor).sum())]
            own = flat[offsets[k] : offsets[k + 1]]
            while len(there):
                some, there = there[:TOGETHER], there[TOGETHER:]
                common = common_counts(own, [flat[offsets[t] : offsets[t + 1]] for t in some])
                for t in some[100 * common >= similarity * (size[some] + size[k] - common)]:
                    if root[t] != root[k]:
                        links.append((max(node[t], node[k]), min(node[t], node[k])))
                        root[root == root[t]] = root[k]
                there = there[root[there] != root[k]]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, similarity: int = SIMILARITY, positions: int = POSITIONS
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, component_id, kept``.

    A document's set holds its distinct runs of ``words`` words (blank-separated, A-Z as a-z); one with
    fewer words has a single run of all; one without words, or null, has none and links to
    nothing. Two documents link if 100 times the shared runs are at least ``similarity`` times all
    runs of both. ``component_id`` is the smallest id that links lead to; ``kept`` marks its document.

    Equal sets are merged first, by an aggregation, so copies cost nothing after it. The others are
    banded by signature; in each bucket every member is compared with the bucket's first, and links
    are confirmed on full sets and joined into components. Buckets that still hold several
    components are then compared whole, in blocks that carry the sets and give links alone. Runs that
    only one set has, counted among all that are left, rule most pairs out exactly, signatures
    most others. So links are lost only if a signature is off by over
    five standard errors, or (probability below ``MISS``) shares no band.

    Rows with a null id link to nothing, have a null ``component_id`` and are kept. Rows that repeat
    an id and text are treated alike. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows, bands = banding(similarity, positions, MISS)
    schema = "doc_id long, text_hash long, n_shingles long, set_one long, set_two long, bands array<long>, low binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    sketches = stored(hashed.mapInArrow(sketch_rows(words, positions, rows, bands), schema), "sketches")
    known = sketches.where("n_shingles > 0 and doc_id is not null")

    same = ["n_shingles", "set_one", "set_two"]
    classes = stored(known.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    nodes = known.join(classes.withColumnRenamed("node", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"])
    nodes = nodes.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "low")
    # Ids may repeat with different texts; a node is known by id and set then.
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1")
    members = stored(banded.join(shared, "bucket"), "buckets")
    candidates = stored(members.select("node").distinct(), "candidates")
    low = stored(nodes.join(candidates, "node", "left_semi").select("node", "n_shingles", "bands", "low"), "low")
    wanted = texts.join(candidates.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(set_rows(words), "node long, members array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), sets.select(
            F.col("node").alias("b"), F.col("members").alias("set_b")
        )
        return pairs.join(a, "a").join(b, "b").mapInArrow(linked_rows(similarity), "a long, b long")

    firsts = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"), "n_shingles").distinct()
    size = low.select(F.col("node").alias("b"), F.col("n_shingles").alias("size_b"))
    fits = 100 * F.least("n_shingles", "size_b") >= similarity * F.greatest("n_shingles", "size_b")
    links = stored(confirmed(firsts.join(size, "b").where(fits).select("a", "b")), "links")
    roots = stored(components(links), "roots")
    able = stored(with_shared(members, roots, low, sets, similarity), "able")
    new = stored(unsettled(members, able, roots, links_of_block(similarity, positions)), "links")
    if not new.isEmpty():
        roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)), "roots")
    found = classes.join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("root"))
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    out = sketches.select("doc_id", "text_hash", *same).join(found, same, "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    )
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay if of each component only its smallest id does.

    Columns stay as they are, whatever their names. Rows with null ids stay, and so do texts without
    words. Rows that repeat an id and text count as one document and stay or go together.
    """
    gone = near_duplicates(docs, **parameters).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, root, asks, n, n_ask`` of buckets that hold several components.

    Members outside the component of a bucket's first one ask; ``n`` and ``n_ask`` count all and those.
    """
    own = roots.withColumnRenamed("root", "own")
    tops = members.select("bucket", F.col("first").alias("node")).distinct().join(roots, "node", "left")
    tops = tops.select("bucket", F.coalesce("root", "node").alias("top"))
    placed = members.join(own, "node", "left").select("bucket", "node", F.coalesce("own", "node").alias("root"))
    placed = placed.join(tops, "bucket").withColumn("asks", F.col("root") != F.col("top"))
    split = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_ask")).where("n_ask > 0")
    return placed.join(split, "bucket").select("bucket", "node", "root", "asks", "n", "n_ask")


def with_shared(members: DataFrame, roots: DataFrame, low: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Nodes of open buckets that can link at all, their sets, and how many elements other sets have too.

    An element that one set alone has is in no intersection. A node whose id has several sets counts
    all elements as shared.
    """
    open_ = stored(open_buckets(members, roots).select("node").distinct(), "open")
    once = low.groupBy("node").agg(F.count("*").alias("sets")).where("sets = 1").select("node")
    elements = sets.join(open_, "node", "left_semi").select("node", F.explode("members").alias("element"))
    alone = elements.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone")).join(once, "node", "left_semi")
    known = low.join(open_, "node", "left_semi").join(alone, "node", "left")
    shared = known.withColumn("shared", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    return shared.where(100 * F.col("shared") >= similarity * F.col("n_shingles")).join(sets, "node")


def unsettled(members: DataFrame, able: DataFrame, roots: DataFrame, compare) -> DataFrame:
    """What ``compare`` finds in the blocks of all buckets that hold several components.

    Members outside a bucket's first component ask, all answer. Askers and answerers
    are cut into blocks of ``BLOCK``, and each pair of blocks is one group.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = open_buckets(members, roots).join(able, "node").withColumn("own", F.xxhash64("node"))
    rows = rows.withColumn("stray", F.col("asks"))
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    asking = rows.where("asks").withColumn("ask", F.pmod("own", blocks("n_ask"))).withColumn("answer", F.explode(every("n")))
    answering = rows.withColumn("answer", F.pmod("own", blocks("n"))).withColumn("ask", F.explode(every("n_ask")))
    columns = ["bucket", "ask", "answer", "node", "root", "shared", "bands", "low", "members", "stray"]
    both = asking.select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("answers")).union(
        answering.select(*columns, F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    )
    return both.groupBy("bucket", "ask", "answer").applyInArrow(compare, "a long, b long")
