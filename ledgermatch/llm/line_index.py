"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

A document's lines are what lies between line feeds (null or empty text: one empty line).
A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys
shorter than ``least`` code points are never dropped.  Keys are held as 128-bit BLAKE2
digests.  ``LineIndex`` keeps three tables in a shared folder, one folder per operation:

postings  (key, doc, live): which documents hold a key; a deletion appends ``live = false``
counts    (key, n, last, gen): exact count of documents and the largest of them; an
          operation writes only the keys that it touched, the newest row counts
filters   (shard, gen, slots): cuckoo filters (16-bit fingerprints, buckets of four) of all
          keys with n > 0; ``gen`` tells which filter of its shard holds a key

``insert`` sends the batch's distinct keys, one row each, to their shard, probes the
filters there, and joins only the hits with the (large) exact table; keys the filters have
never seen are new.  False hits cost a lookup and are put in like any new key, so a
fingerprint is there for every key.  A newest filter that would get too full is left and a
larger one opened.  ``delete`` appends the documents' postings as dead, counts the touched
keys again, and takes fingerprints out of the filter named by ``gen`` when the last
document of a key goes.  ``clean`` drops lines by the exact counts alone.

Skew: a key held by a third of all documents is counted map-side first; its postings meet
the small table of shared keys in a join that adaptive execution splits.

Defined results: rows that share a doc_id are one document; null ids are one document,
below all others; a document whose id is in the index already is not inserted again
(delete it first); documents that were never inserted lose no line; empty tables give
empty results; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import replace_columns, ship
from ledgermatch.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Share of a filter's slots in use up to which keys are added to it.
FULL = 0.84
#: Rounds of moving fingerprints before a filter counts as full.
KICKS = 400


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line's key, or None if the key is too short to be dropped."""
    key = line.strip(SPACE).lower()  # of bytes: ASCII only
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """A cuckoo filter of 16-byte digests; ``slots`` is (buckets, 4), 0 marks a free one."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 16
        while buckets * SLOTS * FULL < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def room(self) -> int:
        return int(self.slots.size * FULL) - int(np.count_nonzero(self.slots))

    def other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ ((fp.astype(np.uint32) * np.uint32(0x5BD1E995)) & np.uint32(len(self.slots) - 1))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)
        fp = np.maximum(d[:, 1] & 0xFFFF, 1).astype(np.uint16)
        one = d[:, 2] & np.uint32(len(self.slots) - 1)
        return fp, one, self.other(one, fp)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        fp, one, two = self.places(keys)
        return ((self.slots[one] == fp[:, None]) | (self.slots[two] == fp[:, None])).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """Put all keys in at once; False (and an unusable filter) if they do not fit."""
        fp, at, _ = self.places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(KICKS):
            order = np.argsort(at, kind="stable")
            at, fp = at[order], fp[order]
            here = np.arange(len(at))
            first = np.r_[True, at[1:] != at[:-1]]
            rank = here - np.maximum.accumulate(np.where(first, here, 0))
            free = self.slots[at] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free, axis=1, kind="stable")[here, np.minimum(rank, SLOTS - 1)]
            self.slots[at[fits], slot[fits]] = fp[fits]
            at, fp = at[~fits], fp[~fits]
            if not len(at):
                return True
            if turn == 0:  # the other bucket may have room
                at = self.other(at, fp)
            else:  # push one fingerprint out of each full bucket
                lead = np.r_[True, at[1:] != at[:-1]]
                where = rng.integers(SLOTS, size=int(lead.sum()))
                out = self.slots[at[lead], where]
                self.slots[at[lead], where] = fp[lead]
                at = np.r_[self.other(at[lead], out), at[~lead]]
                fp = np.r_[out, fp[~lead]]
        return False

    def delete(self, keys: list[bytes]) -> None:
        """Take out one fingerprint for each key; every key must have been put in."""
        for fp, one, two in zip(*self.places(keys)):
            for bucket in (one, two):
                found = np.flatnonzero(self.slots[bucket] == fp)
                if len(found):
                    self.slots[bucket, found[0]] = 0
                    break


FILTERS = "shard int, gen int, slots binary"


def _filters(shard_rows: pa.Table) -> dict[int, Cuckoo]:
    rows = sorted(shard_rows.to_pylist(), key=lambda r: r["gen"])
    return {r["gen"]: Cuckoo.load(r["slots"]) for r in rows}


def _rows_of(shard: int, filters: dict[int, Cuckoo]) -> pa.Table:
    return pa.table({"shard": pa.array([shard] * len(filters), pa.int32()), "gen": pa.array(list(filters), pa.int32()),
                     "slots": pa.array([f.dump() for f in filters.values()], pa.binary())})


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    found = keys.column("key").to_pylist()
    hit = np.zeros(len(found), bool)
    if found:
        for f in _filters(filters).values():
            hit |= f.probe(found)
    return pa.table({"key": pa.array(found, pa.binary()).filter(pa.array(hit))})


def _put(keys: pa.Table, filters: pa.Table) -> pa.Table:
    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    have, new = _filters(filters), keys.column("key").to_pylist()
    if new:
        newest = max(have, default=-1)
        if newest < 0 or have[newest].room() < len(new) or not _tried(have, newest, new):
            f, room = None, 2 * max(len(new), have[newest].slots.size if have else 0)
            while f is None or not f.insert(new):
                f = Cuckoo.sized(room)
                room *= 2
            have[newest + 1] = f
    return _rows_of(shard, have)


def _tried(have: dict[int, Cuckoo], gen: int, new: list[bytes]) -> bool:
    f = Cuckoo(have[gen].slots.copy())
    if not f.insert(new):
        return False
    have[gen] = f
    return True


def _take(keys: pa.Table, filters: pa.Table) -> pa.Table:
    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    have = _filters(filters)
    by_gen: dict[int, list[bytes]] = {}
    for r in keys.to_pylist():
        by_gen.setdefault(r["gen"], []).append(r["key"])
    for gen, gone in by_gen.items():
        have[gen].delete(gone)
    return _rows_of(shard, have)


def _find_keys(least: int, batches):
    for b in batches:
        owner, keys = [], []
        for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            found = {line_key(line, least) for line in (text or b"").split(b"\n")} - {None}
            owner += [i] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(keys, pa.binary())], ["doc", "key"])


class LineIndex:
    """An index at ``path`` (a shared folder), opened as it was left.

    ``shards``: filters per generation; choose about one for each million distinct lines.
    ``least``: shortest key in code points.  Both must stay the same for one path.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, least: int = 20):
        self.spark, self.path, self.shards, self.least = spark, path.rstrip("/"), shards, least
        try:
            done = spark.read.parquet(f"{self.path}/done").collect()  # one row an operation
        except AnalysisException:
            done = []
        self.ops = sorted(r["at"] for r in done)
        self.deletions = any(r["deletion"] for r in done)

    def _read(self, table: str, ops: list[int]) -> DataFrame:
        return (self.spark.read.option("basePath", f"{self.path}/{table}")
                .parquet(*[f"{self.path}/{table}/at={k}" for k in ops]))

    def postings(self) -> DataFrame:
        """(key, doc) of the documents that are in the index."""
        p = self._read("postings", self.ops)
        if self.deletions:
            p = p.groupBy("key", "doc").agg(F.max_by("live", "at").alias("live")).where("live")
        return p.select("key", "doc")

    def counts(self) -> DataFrame:
        """(key, n, last, gen): number of documents that hold the key, the largest, its filter."""
        c = self._read("counts", self.ops)
        if len(self.ops) > 1:
            c = c.groupBy("key").agg(F.max_by(F.struct("n", "last", "gen"), "at").alias("c")).select("key", "c.*")
        return c.where("n > 0").select("key", "n", "last", "gen")

    def filters(self) -> DataFrame:
        if not self.ops:
            return self.spark.createDataFrame([], FILTERS)
        return self._read("filters", self.ops[-1:]).select("shard", "gen", "slots")

    def _shard(self):
        return F.expr(f"cast(pmod(cast(conv(hex(substring(key, 13, 4)), 16, 10) as bigint), {self.shards}) as int)").alias("shard")

    def _commit(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, deletion: bool) -> None:
        at = self.ops[-1] + 1 if self.ops else 0
        for table, df in (("postings", postings), ("filters", filters), ("counts", counts(filters) if callable(counts) else counts)):
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/at={at}")
        self.spark.createDataFrame([(at, deletion)], "at int, deletion boolean").write.mode("append").parquet(f"{self.path}/done")
        self.ops.append(at)
        self.deletions |= deletion

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> None:
        """Add documents.  A large batch goes in by ``rounds`` parts, so that the group of a
        shard stays small; later rounds are screened by the filters of the earlier ones."""
        ship()
        kind = docs.schema[id_col].dataType.simpleString()
        found = (docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
                 .mapInArrow(partial(_find_keys, self.least), f"doc {kind}, key binary").dropDuplicates(["doc", "key"]))
        if self.ops:
            there = self.postings().select("doc").distinct()
            found = found.join(there, found["doc"].eqNullSafe(there["doc"]), "left_anti")
        found = materialize(found.withColumn("round", F.expr(f"pmod(xxhash64(doc), {rounds})")), "line-keys")
        for k in range(rounds):
            self._insert(found.where(F.col("round") == k).select("key", "doc"))

    def _insert(self, pairs: DataFrame) -> None:
        keys = materialize(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
                           .select(self._shard(), "*"), "line-batch")
        if self.ops:
            old = self.filters()
            hits = keys.select("shard", "key").groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_probe, "key binary")
            met = self.counts().join(hits, "key").select("key", F.col("n").alias("n0"), F.col("last").alias("last0"), F.col("gen").alias("gen0"))
            keys = materialize(keys.join(met, "key", "left"), "line-met")
        else:
            old = self.filters()
            keys = keys.select("*", F.lit(0).alias("n0"), F.col("last").alias("last0"), F.lit(None).cast("int").alias("gen0"))
        new = keys.where("gen0 is null").select("shard", "key")
        filters = materialize(new.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_put, FILTERS), "line-filters")
        # one row a shard
        newest = filters.groupBy("shard").agg(F.max("gen").alias("newest"))
        counts = keys.join(newest, "shard", "left").select(
            "key", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("last", "last0").alias("last"),
            F.coalesce("gen0", "newest").alias("gen"))
        self._commit(pairs.select("key", "doc", F.lit(True).alias("live")), counts, filters, False)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose id is in the first column of ``ids``; ids that are
        not in the index are ignored.  Counts are then as if they had never been inserted."""
        if not self.ops:
            return
        ship()
        ids = ids.select(F.col(ids.columns[0]).alias("doc")).distinct()
        live = self.postings()
        gone = materialize(live.join(ids, live["doc"].eqNullSafe(ids["doc"]), "left_semi"), "line-gone")
        touched = gone.select("key").distinct()
        rest = live.join(ids, live["doc"].eqNullSafe(ids["doc"]), "left_anti").join(touched, "key", "left_semi")
        left = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
        counts = materialize(self.counts().select("key", "gen").join(touched, "key").join(left, "key", "left")
                             .select("key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "last", "gen"), "line-left")
        dead = counts.where("n = 0").select(self._shard(), "key", "gen")
        filters = materialize(dead.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_take, FILTERS), "line-filters")
        self._commit(gone.select("key", "doc", F.lit(False).alias("live")), counts, filters, True)

    def clean(self, docs: DataFrame, at_least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept``: the text without
        the lines whose key is held by ``at_least`` documents of the index, unless the
        document is the largest that holds it."""
        ship()
        shared = materialize(self.counts().where(F.col("n") >= at_least).select("key", "last"), "line-shared")
        drops = (self.postings().join(shared, "key").where(~F.col("doc").eqNullSafe(F.col("last")))
                 .groupBy("doc").agg(F.collect_list("key").alias("__lm_keys")))
        drops = materialize(drops.withColumnRenamed("doc", "__lm_doc"), "line-drops")
        least = self.least

        @arrow_udf("struct<n: bigint, kept: string>")
        def without(text: pa.Array, keys: pa.Array) -> pa.Array:
            counts, kept = [], []
            for t, ks in zip(text.cast(pa.binary()), keys):
                if not ks.is_valid:
                    counts.append(0)
                    kept.append(None)
                    continue
                gone = set(ks.as_py())
                lines = t.as_py().split(b"\n")
                rest = [x for x in lines if line_key(x, least) not in gone]
                counts.append(len(lines) - len(rest))
                kept.append(b"\n".join(rest))
            return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n", "kept"])

        text = F.coalesce(text_col, F.lit(""))
        hit = F.col("__lm_keys").isNotNull()
        made = docs.join(drops, docs[id_col].eqNullSafe(drops["__lm_doc"]), "left").withColumn(
            "__lm_out", without(F.when(hit, text), "__lm_keys"))
        return replace_columns(
            made, n_lines=(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("bigint"),
            n_dropped=F.col("__lm_out.n"), kept=F.coalesce("__lm_out.kept", text)).drop("__lm_doc", "__lm_keys", "__lm_out")


def dedup_lines(docs: DataFrame, path: str, at_least: int = 3, least: int = 20, shards: int = 64, rounds: int = 2) -> DataFrame:
    """Load ``docs`` into a new index at ``path`` and drop their repeated lines."""
    index = LineIndex(docs.sparkSession, path, shards, least)
    index.insert(docs, rounds=rounds)
    return index.clean(docs, at_least)
