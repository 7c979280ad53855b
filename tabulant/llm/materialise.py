"""Binary shards of token ids in training order: a keyed permutation gives every sequence its slot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.llm import bpe
from tabulant.llm.shared import prefix_sums, python_ready, released
from tabulant.storage import new_path, stored

#: Tokens to a sequence, bytes to a token, and sequences to a shard file.
SEQUENCE, WIDTH, PER_SHARD = 1024, 2, 4096
ROUNDS = 6
#: How hard the stored tokens are compressed: they take a tenth less than at Spark's level of 3.
LEVEL = 5
#: The bits of a row's number that count within its part.
ROW = (1 << 33) - 1


class Permutation:
    """A keyed bijection of 0 .. size-1: a Feistel network on a square, walked until it lands inside."""

    def __init__(self, size: int, key: int) -> None:
        self.size = size
        self.half = max(1, -(-max(size - 1, 1).bit_length() // 2))
        seeds = hashlib.sha256(f"{key}/{size}".encode()).digest()
        self.keys = np.frombuffer(hashlib.sha512(seeds).digest(), np.uint64)[:ROUNDS]

    def scatter(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def walk(self, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        out, open_ = values.astype(np.uint64), np.arange(len(values))
        while len(open_):
            left, right = out[open_] >> bits, out[open_] & mask
            for key in keys:
                left, right = right, left ^ self.scatter(right, key)
            out[open_] = right << bits | left  # halves change places, so that keys in reverse undo it
            open_ = open_[out[open_] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self.walk(sequences, self.keys)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self.walk(slots, self.keys[::-1])


def packed(ids: pa.ListArray, end: int, width: int) -> pa.BinaryArray:
    """Lists of ids as bytes, little-endian, with ``end`` after the last of each; a null list is empty."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.cumsum(sizes)
    data = np.insert(ids.flatten().to_numpy(zero_copy_only=False), stops, end).astype({1: "<u1", 2: "<u2", 4: "<u4"}[width])
    offsets = np.concatenate(([0], stops + np.arange(1, len(sizes) + 1))).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def packed_ids(spark: SparkSession, end: int, width: int = WIDTH):
    """A column function from arrays of token ids to bytes, little-endian, with ``end`` after the last."""
    python_ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield packed(batch, end, width)

    return F.arrow_udf(run, "binary")


def packed_texts(spark: SparkSession, tokenizer: bpe.Tokenizer, end: int, width: int = WIDTH):
    """A column function from texts to the bytes of their ids with ``end`` after the last: encoded and packed in one pass through Python."""
    python_ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = bpe.Memory(tokenizer)
        for batch in batches:
            yield packed(bpe.encoded(memory, batch.to_pylist()), end, width)
        del memory
        released()

    return F.arrow_udf(run, "binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(folder: str, stride: int, per_shard: int, total: int):
    """For mapInArrow over pieces sorted by shard, slot and place: writes whole shards, gives their manifest.

    A shard is written beside its name and moved onto it when complete; a task that runs again
    writes the same bytes, so a lost executor leaves no torn file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        now, sink, digest, size = None, None, None, 0

        def close() -> pa.RecordBatch:
            nonlocal sink
            # The last sequence of all may end early; zeros fill it.
            fill = min(per_shard, total - now * per_shard) * stride
            sink.write(bytes(fill - size))
            digest.update(bytes(fill - size))
            sink.close()
            sink = None
            name = f"{root}/{shard_name(now)}"
            files.move(f"{name}.{unique}", name)
            return pa.RecordBatch.from_pydict(
                {"shard": [now], "path": [f"{folder}/{shard_name(now)}"], "first_slot": [now * per_shard], "sequences": [fill // stride],
                 "bytes": [fill], "sha256": [digest.hexdigest()]}
            )

        unique = f"{id(batches):x}-{np.random.SeedSequence().entropy:x}"
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "slot", "place", "piece")]
            for shard, slot, place, piece in zip(*columns):
                if shard != now:
                    if sink:
                        yield close()
                    now, digest, size = shard, hashlib.sha256(), 0
                    sink = files.open_output_stream(f"{root}/{shard_name(shard)}.{unique}")
                at = (slot - shard * per_shard) * stride + place
                for part in (bytes(at - size), piece):
                    sink.write(part)
                    digest.update(part)
                size = at + len(piece)
        if sink:
            yield close()

    return run


def starts_below(folder: str):
    """For an Arrow UDF: where in the stream each row starts, from tables below ``folder``, one for each part of the rows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        files, root = fs.FileSystem.from_uri(folder)
        now, held = None, None
        for batch in batches:
            rows = batch.to_numpy(zero_copy_only=False)
            out = np.zeros(len(rows), np.int64)
            for part in np.unique(rows >> 33):
                if part != now:
                    table = pq.read_table(f"{root}/part={part}", filesystem=files, partitioning=None)
                    now, held = part, table.column("start").to_numpy()[np.argsort(table.column("at").to_numpy())]
                own = rows >> 33 == part
                out[own] = held[rows[own] & ROW]
            yield pa.array(out)

    return run


def materialise(
    docs: DataFrame, folder: str, *, key: int = 1, sequence: int = SEQUENCE, width: int = WIDTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """Write the token stream of ``docs`` to shards in ``folder``; gives ``shard, path, first_slot, sequences, bytes, sha256``.

    ``docs`` has ``doc_id`` and ``tokens``, bytes of ``width`` a token. In order of id (null ids
    last, then by the tokens' hash) documents form one stream, cut into sequences of
    ``sequence`` tokens; the last is filled with zeros. Sequence ``i`` goes to slot ``Permutation(n, key)``
    says, and slot ``s`` lies in shard ``s // per_shard`` at byte ``s % per_shard * stride``: a reader
    that knows where it stopped goes on there, and the order of reading is the order of training.

    Tokens are stored with a number for each row. Prefix sums of lengths place the documents, so only
    lengths are sorted; every task looks up its rows' starts where they are stored, and pieces of
    documents then move once, to the range of shards they belong to. ``folder`` is a URI that all executors reach
    and that does not hold shards yet. Null tokens have none; rows repeated are stored as often; an
    empty table writes nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    stride = sequence * width
    tokens = docs.select("doc_id", F.coalesce("tokens", F.lit(b"")).alias("tokens"))
    rows = tokens.select("*", F.xxhash64("tokens").alias("hash"), F.length("tokens").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    path = new_path(spark, "tokens")
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    total = rows.agg(F.sum("size")).first()[0] or 0
    sequences = -(-total // stride)
    if not sequences:
        return spark.createDataFrame([], MANIFEST)
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    placed = prefix_sums(rows.select("doc_id", "hash", "size", "row"), order, {"start": F.col("size")}, "placed")
    starts = placed.select(F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit(ROW)).alias("at"), "start")
    found = new_path(spark, "starts")
    starts.repartition("part").sortWithinPartitions("part", "at").write.partitionBy("part").parquet(found)
    start = F.arrow_udf(starts_below(found), "long")("row")
    each = rows.where("size > 0").select("tokens", "size", start.alias("start"))

    def cut(number):
        first = F.greatest(number * stride, F.col("start"))
        last = F.least((number + 1) * stride, F.col("start") + F.col("size"))
        piece = F.substring(F.col("tokens"), (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
        return F.struct(number.alias("sequence"), (first - number * stride).alias("place"), piece.alias("piece"))

    numbers = F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("size") - 1) / stride))
    # Pieces are cut before they are dealt out, so that a long document isn't copied for each.
    pieces = each.select(F.transform(numbers, cut).alias("pieces")).select(F.explode("pieces").alias("p")).select("p.*")
    order_of = Permutation(sequences, key)

    def slots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(order_of.slots(batch.to_numpy(zero_copy_only=False)))

    slotted = pieces.select(F.arrow_udf(slots, "long")("sequence").alias("slot"), "place", "piece")
    sharded = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard))
    shards = -(-sequences // per_shard)
    ranged = sharded.repartitionByRange(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    ready = ranged.sortWithinPartitions("shard", "slot", "place").select("shard", "slot", "place", "piece")
    fs_folder, root = fs.FileSystem.from_uri(folder)
    fs_folder.create_dir(root, recursive=True)
    return stored(ready.mapInArrow(write_shards(folder.rstrip("/"), stride, per_shard, sequences), MANIFEST), "manifest")


MANIFEST = "shard long, path string, first_slot long, sequences long, bytes long, sha256 string"


def read_back(
    spark: SparkSession, manifest: DataFrame, *, key: int = 1, sequence: int = SEQUENCE, width: int = WIDTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """Every sequence of written shards: ``slot, sequence, shard, byte_offset, tokens_sha256``."""
    python_ready(spark)
    stride = sequence * width
    total = manifest.agg(F.sum("sequences")).first()[0] or 0
    order_of = Permutation(max(total, 1), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shard in zip(batch.column("path").to_pylist(), batch.column("shard").to_pylist()):
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_stream(name) as stream:
                    found = []
                    while record := stream.read(stride):
                        found.append(hashlib.sha256(record).hexdigest())
                slot = shard * per_shard + np.arange(len(found))
                yield pa.RecordBatch.from_pydict(
                    {"slot": slot, "sequence": order_of.sequences(slot), "shard": [shard] * len(found),
                     "byte_offset": np.arange(len(found)) * stride, "tokens_sha256": found}
                )

    schema = "slot long, sequence long, shard long, byte_offset long, tokens_sha256 string"
    return manifest.select("shard", "path").mapInArrow(run, schema)
