"""Ranked lexical search: tiles of item vocabulary times tiles of document impacts, in exact float64 products."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabulant.llm.shared import prefix_sums, shipped
from tabulant.storage import new_path, stored

#: How many documents an item gets.
BEST = 20
#: Fixed values of the measure: the scale of weights, of the share that a term's frequency earns, its steepness, and length's part.
WEIGHT, UNIT, OWN, STEEP, LENGTH = 1000, 1_000_000_000, 1000, 12, 25
#: No term earns more than this share, whatever its frequency.
MOST = UNIT // OWN
#: Whole numbers below this are exact in float64, and so are sums of them.
EXACT = 1 << 53
#: Documents, terms and items to a tile; bytes of items searched in one pass over the documents; bytes of a text split at a time.
DOCS, TERMS, ITEMS, BLOCK, PART = 256, 4096, 256, 1 << 20, 1 << 20
#: Bytes that count as parts of terms, A-Z lowered; all others separate. In UTF-8 bytes from 0x80 on belong to characters beyond ASCII.
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def term_counts(text: bytes | None) -> Counter:
    """The terms of a text in UTF-8, whole, in parts that end between terms."""
    found: Counter = Counter()
    folded = (text or b"").translate(FOLDED)
    start = 0
    while len(folded) - start > PART and (stop := folded.find(b" ", start + PART)) >= 0:
        found.update(folded[start:stop].split())
        start = stop
    found.update(folded[start:].split())
    return found


POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document: its number of terms, and those of the vocabulary by place with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: k for k, term in enumerate(vocabulary)}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, DOCS):
                sizes, lengths, terms, tfs = [], [], [], []
                for text in texts[at : at + DOCS].to_pylist():
                    counts = term_counts(text)
                    held = [(place[t], c) for t, c in counts.items() if t in place]
                    lengths.append(counts.total())
                    sizes.append(len(held))
                    terms += [t for t, _ in held]
                    tfs += [c for _, c in held]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                columns = [
                    batch.column(0)[at : at + DOCS], pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


class Tiles:
    """Items' counts of terms in tiles whose products with impacts stay exact.

    A tile has at most ``ITEMS`` items and ``TERMS`` columns, and for each of its items the largest score that its
    columns could add is below 2^53; then float64 products and their sums in any order are exact, and only whole
    partial sums are added, as 64-bit integers. A count too large for that is several columns of one term.
    """

    def __init__(self, items: list[dict[int, int]], weights: list[int]) -> None:
        self.weights = np.array(weights, np.int64)
        self.items = len(items)
        self.tiles = []
        for first in range(0, len(items), ITEMS):
            by_term: dict[int, list[tuple[int, int]]] = {}
            for own, counts in enumerate(items[first : first + ITEMS]):
                for term, count in counts.items():
                    by_term.setdefault(term, []).append((own, count))
            terms, entries, bound = [], [], Counter()

            def close(first=first) -> None:
                rows, owners, counts = (np.array(x, np.int64) for x in zip(*entries))
                self.tiles.append((first, np.array(terms), rows, owners, counts))

            for term in sorted(by_term):
                left = dict(by_term[term])
                most = max(1, (EXACT - 1) // max(1, weights[term] * MOST))
                while left:
                    column = {own: min(count, most) for own, count in left.items()}
                    cost = {own: count * weights[term] * MOST for own, count in column.items()}
                    if terms and (len(terms) == TERMS or any(bound[own] + c >= EXACT for own, c in cost.items())):
                        close()
                        terms, entries, bound = [], [], Counter()
                    entries += [(len(terms), own, count) for own, count in column.items()]
                    terms.append(term)
                    bound.update(cost)
                    left = {own: count - most for own, count in left.items() if count > most}
            if terms:
                close()

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` documents for all items, from impacts at (row, term)."""
        out = np.zeros((rows, self.items), np.int64)
        seen = np.zeros(len(self.weights), bool)
        seen[term] = True
        for first, terms, columns, owners, counts in self.tiles:
            used = seen[terms]
            if not used.any():
                continue
            # Columns that these documents lack are left out; columns of one term stand side by side.
            own = terms[used]
            compact = np.cumsum(used) - 1
            items = min(ITEMS, self.items - first)
            here = used[columns]
            right = np.zeros((len(own), items))
            right[compact[columns[here]], owners[here]] = counts[here]
            left = np.zeros((rows, len(own)))
            r, t, x, at = row, term, impact, np.searchsorted(own, term)
            while len(at):
                inside = at < len(own)
                inside[inside] = own[at[inside]] == t[inside]
                r, t, x, at = r[inside], t[inside], x[inside], at[inside]
                left[r, at] = x
                at = at + 1
            out[:, first : first + items] += (left @ right).astype(np.int64)
        return out


class Best:
    """The best documents of each item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, items: int, best: int) -> None:
        self.best = best
        self.item, self.score, self.doc, self.null = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """A tile's scores; those equal to the lowest kept stay in, as their ids decide."""
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        columns = (self.item, item), (self.score, scores[row, item]), (self.doc, docs[row]), (self.null, null[row])
        item, score, doc, null = (np.concatenate(c) for c in columns)
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        start = np.concatenate(([True], item[1:] != item[:-1]))
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(start, np.arange(len(item)), 0))
        keep = order[place < self.best]
        full = place == self.best - 1
        self.item, self.score, self.doc, self.null = (np.concatenate(c)[keep] for c in columns)
        self.floor[item[full]] = score[order[full]]


def impacts(n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What each term of each document adds to a score."""
    length = np.array([100 - LENGTH + LENGTH * k * documents // terms for k in n.tolist()], np.int64)
    return weights[term] * (UNIT * tf // (OWN * tf + STEEP * length[row]))


def search_block(docs: DataFrame, items: list[tuple[object, str | None]], kind: T.DataType, best: int) -> DataFrame:
    """The best documents of a bounded list of items: one pass over texts, then over what they share with the items."""
    counts = [term_counts((text or "").encode()) for _, text in items]
    vocabulary = sorted({t for own in counts for t in own})
    place = {t: k for k, t in enumerate(vocabulary)}
    shared = stored(postings(docs, vocabulary), "postings")
    whole = shared.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, terms = int(whole[0]), int(whole[1] or 0)
    held = {r.term: r.df for r in shared.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = [math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(vocabulary))]
    tiles = Tiles([{place[t]: c for t, c in own.items() if place[t] in held} for own in counts], weights)
    ids = [i for i, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(ids), best)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                doc, n, term, tf = (part.column(c) for c in range(4))
                row = np.repeat(np.arange(part.num_rows), term.value_lengths().to_numpy())
                term, tf, n = (x.to_numpy(zero_copy_only=False) for x in (term.flatten(), tf.flatten(), n))
                if len(term):
                    impact = impacts(n, row, term, tf, tiles.weights, documents, terms)
                    null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                    found.add(tiles.scores(row, term, impact, part.num_rows), doc.fill_null(0).to_numpy(), null)
        doc = pa.array(found.doc, mask=found.null == 1)
        columns = {"item": found.item, "item_id": pa.array([ids[k] for k in found.item], arrow_kind), "doc_id": doc, "score": found.score}
        yield pa.RecordBatch.from_pydict(columns)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    schema = T.StructType().add("item", "long").add("item_id", kind).add("doc_id", "long").add("score", "long")
    each = shared.where("size(terms) > 0").mapInArrow(run, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Tasks' lists meet in parts first, so that no item's list grows with the number of tasks.
    parts = each.withColumn("meets", F.spark_partition_id() % 64)
    ranked = F.row_number()
    first = parts.withColumn("rank", ranked.over(Window.partitionBy("item", "meets").orderBy(*order))).where(F.col("rank") <= best)
    last = first.withColumn("rank", ranked.over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)
    return last.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): ``item_id, rank, doc_id, score``.

    Terms are runs of digits, letters A-Z in any case and characters beyond ASCII. A term's weight falls with the
    number of documents that hold it; its share rises with its frequency and falls with the document's length; an item's
    score is the sum over its terms, repeats included, in whole numbers. Only scores above 0 rank; equal ones rank by id.

    Items are taken in blocks of about a megabyte of text (one larger item is a block), and each block's vocabulary
    goes to all tasks. Texts are split once a block; what they share with the vocabulary is stored, gives the counts of
    documents by term, and is multiplied in tiles. A task gives no more than ``best`` rows an item. Texts may
    have any length; the terms of one are counted a part at a time. Null texts and empty ones have no terms: such items have no rows, such
    documents don't count. Rows repeated are documents, or items, of their own. A null id ranks behind other ids. Ids of
    documents are integers. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shipped(spark)
    asked = items.select("item_id", "text")
    kind = asked.schema["item_id"].dataType
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    total = asked.agg(F.sum(size)).first()[0] or 0
    if total <= BLOCK:
        return search_block(docs, [tuple(r) for r in asked.collect()], kind, best)
    order = [F.col("item_id").asc_nulls_last(), F.xxhash64("text")]
    placed = stored(prefix_sums(asked, order, {"start": size}, "items").withColumn("block", F.floor(F.col("start") / BLOCK)), "items")
    paths = []
    for block in range(-(-total // BLOCK)):
        own = [(r.item_id, r.text) for r in placed.where(F.col("block") == block).collect()]
        if own:
            paths.append(new_path(spark, "ranked"))
            search_block(docs, own, kind, best).write.parquet(paths[-1])
    schema = T.StructType().add("item_id", kind).add("rank", "integer").add("doc_id", "long").add("score", "long")
    return spark.read.schema(schema).parquet(*paths)
