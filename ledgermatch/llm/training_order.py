"""Token ids in training order: keyed permutations, fixed-stride binary shards.

1. Every row of a stored table has a number without any shuffle: its index in its file
   plus the rows of the files before it.
2. A keyed Feistel network over the next power of four permutes numbers; a result beyond
   the last number is permuted again until it is inside (cycle-walking).  So every document
   has a distinct slot in 0 .. N-1, and slots follow from the key and the number alone.
3. Partitions are ranges of slots (by arithmetic, no sampling): the one shuffle of texts.
   A shard is a range of ``docs_per_shard`` slots.  Its documents are tokenised in slot
   order, each ended by ``end_id``, and packed into sequences of ``length`` ids.
4. A second keyed permutation, of a shard's sequences, takes those of one document apart.
   A sequence's global slot is the number of sequences in the shards before, plus its
   place in its own shard.
5. Spark's text writer writes a shard as one file of records of equal size, in slot order
   (uncompressed, one line-feed byte after each record), so byte offsets give slots and a
   reader can start at any of them.  Files appear when their task commits; a lost
   executor's shards are written again with the same bytes.

Record: first document's id (int64; 0 if null, see flags), index of the first id in that
document (int64), number of ids that are not padding (int32), flags (int32; 1: the id is
null), ``length`` ids (uint16, little-endian, padded by ``end_id``), line feed.

Defined results: null text is empty text (its end id alone); repeated rows are documents
of their own; only the last sequence of a shard is padded; an empty table has no shards.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import ship
from ledgermatch.session import ensure_checkpoint_dir

LENGTH = 1024
DOCS_PER_SHARD = 4096
#: Shuffle partitions at most; beyond, a partition writes several shards one after another.
MOST_PARTITIONS = 20000
#: Tables with one row a file are broadcast up to this number of files (about 20 MB).
BROADCAST_FILES = 100_000
HEADER = struct.Struct("<qqii")
ROUNDS = 6


def stride(length: int = LENGTH) -> int:
    return HEADER.size + 2 * length + 1


def _mix(x: np.ndarray, key: int, r: int) -> np.ndarray:
    """A round's function: 64-bit multiply and shift mixing of a half, the key and the round."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. n-1 at ``numbers``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key, r) & low)
        return (left << shift) | right

    x = once(np.asarray(numbers, np.uint64))
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):  # cycle-walking
        x[out] = once(x[out])
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def slot_of(number: Column, n: int, key: int) -> Column:
    @arrow_udf("bigint")
    def slot(v: pa.Array) -> pa.Array:
        return pa.array(permute(v.to_numpy(zero_copy_only=False), n, key))

    return slot(number)


def numbered(table: DataFrame, *cols: str) -> tuple[DataFrame, int]:
    """``table`` (read from files) with ``number``, dense from 0, and how many rows it has."""
    files = table.select(F.col("_metadata.file_path").alias("__lm_f")).groupBy("__lm_f").agg(F.count(F.lit(1)).alias("n"))
    # one row a file
    starts = files.select("__lm_f", F.expr("coalesce(sum(n) over (order by __lm_f rows between unbounded preceding and 1 preceding), 0)").alias("__lm_s"))
    n, n_files = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if n_files <= BROADCAST_FILES:  # else the join moves the rows
        starts = F.broadcast(starts)
    rows = table.select(*cols, F.col("_metadata.file_path").alias("__lm_f"), F.col("_metadata.row_index").alias("__lm_i"))
    return rows.join(starts, "__lm_f").select(*cols, (F.col("__lm_s") + F.col("__lm_i")).alias("number")), n


class _Shard:
    """Packs the documents of one shard, then gives its sequences their places."""

    def __init__(self, shard: int, length: int, end_id: int, key: int):
        self.shard, self.length, self.end_id, self.key = shard, length, end_id, key
        self.rest = np.empty(0, np.uint16)
        self.first: tuple | None = None
        self.done: list[bytes] = []

    def _record(self, ids: np.ndarray, first: tuple, n: int) -> bytes:
        doc, offset = first
        return HEADER.pack(doc if doc is not None else 0, offset, n, doc is None) + ids.tobytes()

    def add(self, doc, ids: np.ndarray) -> None:
        have = len(self.rest)
        if not have:
            self.first = (doc, 0)
        stream = np.concatenate([self.rest, ids]) if have else ids
        full = len(stream) // self.length
        for i in range(full):
            a = i * self.length
            first = self.first if i == 0 else (doc, a - have)
            self.done.append(self._record(stream[a:a + self.length], first, self.length))
        self.rest = stream[full * self.length:]
        if full:
            self.first = (doc, full * self.length - have)

    def finish(self) -> pa.RecordBatch:
        if len(self.rest):
            padded = np.full(self.length, self.end_id, np.uint16)
            padded[:len(self.rest)] = self.rest
            self.done.append(self._record(padded, self.first, len(self.rest)))
        n = len(self.done)
        places = permute(np.arange(n), n, self.key ^ (self.shard + 1))
        order = np.argsort(places)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.shard, np.int64)), pa.array(np.arange(n)), pa.array([self.done[i] for i in order], pa.binary())],
            ["shard", "place", "record"])


_ENCODERS: dict[int, object] = {}


def _encoder(rank_file: bytes, pattern: str):
    key = zlib.crc32(rank_file)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def write_shards(table: DataFrame, path: str, rank_path: str, pattern: str, end_id: int, key: int,
                 length: int = LENGTH, docs_per_shard: int = DOCS_PER_SHARD, id_col: str = "doc_id",
                 text_col: str = "text") -> int:
    """Write ``table`` (read from files) as shards below ``path``; returns how many shards."""
    ship()
    with open(rank_path, "rb") as f:
        rank_file = f.read()
    docs, n = numbered(table.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), "_metadata"), "doc_id", "text")
    shards = -(-n // docs_per_shard)
    if not n:
        return 0
    parts = min(shards, MOST_PARTITIONS)

    def pack(batches):
        enc, now = _encoder(rank_file, pattern), None
        end = np.array([end_id], np.uint16)
        for b in batches:
            for shard, doc, text in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                if now is None or now.shard != shard:
                    if now is not None:
                        yield now.finish()
                    now = _Shard(shard, length, end_id, key)
                ids = enc.encode_to_numpy(text.as_py() or "", disallowed_special=())
                now.add(doc, np.concatenate([ids.astype(np.uint16), end]))
        if now is not None:
            yield now.finish()

    slotted = docs.withColumn("slot", slot_of(F.col("number"), n, key)).withColumn("shard", F.expr(f"slot div {int(docs_per_shard)}"))
    ranged = slotted.select("shard", "slot", "doc_id", "text").repartitionById(
        parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("shard", "slot")
    packed = ranged.select("shard", "doc_id", "text").mapInArrow(pack, "shard bigint, place bigint, record binary")
    # the writer orders rows by shard alone, and a sort that spills mixes equal keys: the order
    # by place must be the plan's own, which the writer then keeps
    placed = packed.sortWithinPartitions("shard", "place")
    (placed.select("shard", F.col("record").cast("string").alias("value"))
     .write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path))
    return shards


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """shard, path, records and first_slot of every shard, from the files' sizes alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    sized = files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("bigint").alias("shard"), "path",
                         F.expr(f"length div {stride(length)}").alias("records"))
    # one row a shard
    return sized.withColumn("first_slot", F.expr("coalesce(sum(records) over (order by shard rows between unbounded preceding and 1 preceding), 0)"))


def read_sequences(spark: SparkSession, path: str, length: int = LENGTH, first: int = 0, last: int | None = None) -> DataFrame:
    """The sequences of slots ``first`` to ``last`` (exclusive; None: the end), as shard, slot,
    doc_id, offset, n_ids and ids (binary).  Only shards that hold such slots are opened."""
    m = manifest(spark, path, length)
    m = m.where(F.col("first_slot") + F.col("records") > first)
    if last is not None:
        m = m.where(F.col("first_slot") < last)
    if m.count() <= BROADCAST_FILES:  # else the join moves the shards
        m = F.broadcast(m)
    size = stride(length)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    lo = F.greatest(F.lit(first), F.col("first_slot")) - F.col("first_slot")
    hi = F.least(F.lit(last if last is not None else 1 << 62), F.col("first_slot") + F.col("records")) - F.col("first_slot")
    rows = content.join(m, "path").select("shard", "first_slot", "content", F.explode(F.sequence(lo, hi - 1)).alias("place"))
    at = (F.col("place") * size).cast("int")

    def number(start: int, n: int) -> Column:
        # little-endian: reverse the bytes by their hex digits
        part = F.substring("content", at + 1 + start, F.lit(n))
        swapped = F.concat(*[F.hex(F.substring(part, i, 1)) for i in range(n, 0, -1)])
        return swapped

    def signed(start: int, n: int) -> Column:
        h = number(start, n)
        v = F.conv(h, 16, -10)
        return v.cast("bigint")

    flags = signed(20, 4)
    return rows.select("shard", (F.col("first_slot") + F.col("place")).alias("slot"),
                       F.when(flags == 0, signed(0, 8)).alias("doc_id"), signed(8, 8).alias("offset"), signed(16, 4).alias("n_ids"),
                       F.substring("content", at + 1 + HEADER.size, F.lit(2 * length)).alias("ids"))


def shards_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place of the session."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
