"""SimHash near-duplicates: fingerprints, block join, bit check, components.

Fingerprint: ASCII capitals are lower-cased, words are runs of anything but ASCII white
space, shingles are runs of ``shingle`` words joined by single spaces, repeats included (fewer words: the
whole sequence; no word: fingerprint zero).  Each shingle is hashed by XXH64 with seed 42;
a bit is set if it is set in over half of the hashes.

Links: equal texts and other equal fingerprints fall together first, so that only distinct
fingerprints are compared.  Each is split into ``bits + 2`` blocks.  Two fingerprints that
differ in at most ``bits`` bits agree in two blocks at least, so they share a key made of
that pair of blocks.  Fingerprints are joined on these keys and the bits that differ are
counted.  A key with more than ``pairs_up_to`` fingerprints (a large family of near copies)
is not joined with itself: there, every fingerprint also gives the values that differ from
it in up to half the allowed bits outside the key; fingerprints that share such a value are
linked to their smallest.  Values shared that way are at most ``bits`` apart, and any two
that close share one, so the components are exactly the same, with work in proportion to
the fingerprints instead of their pairs.

Defined results: a null text has no words; a null doc_id never names a component unless
all doc_ids of the component are null; repeated rows are members of one component.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import ship
from ledgermatch.llm.components import components
from ledgermatch.session import materialize

SEED = 42
#: Hashes whose bits are counted at once.
PART = 200_000


def _hashes(text: bytes, shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # of bytes: ASCII capitals, ASCII white space
    if not w:
        return []
    line = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    cut = [line[a:b - 1] for a, b in zip(starts, ends[shingle - 1:])] or [line]
    return list(map(xxh64_intdigest, cut, repeat(SEED)))


def fingerprint_of(text: bytes | None, shingle: int) -> int:
    h = np.array(_hashes(text or b"", shingle), np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), PART):
        part = h[a:a + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinter(shingle: int):
    """Column function: text -> 64-bit fingerprint (as a signed long)."""
    ship()

    @arrow_udf("bigint")
    def fingerprint(text: pa.Array) -> pa.Array:
        texts = text.cast(pa.binary()).to_pylist()
        return pa.array([fingerprint_of(t, shingle) for t in texts], pa.int64())

    return fingerprint


def _masks(bits: int) -> list[int]:
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(fp: Column, mask: int, flips: int) -> Column:
    """``fp`` and all values that differ from it in up to ``flips`` bits outside ``mask``."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    deltas = [0]
    for k in range(1, flips + 1):
        for some in combinations(free, k):
            deltas.append(sum(some))
    return F.transform(F.array(*[F.lit(_signed(d)) for d in deltas]), lambda d: fp.bitwiseXOR(d))


def links(fingerprints: DataFrame, bits: int, pairs_up_to: int = 64) -> DataFrame:
    """``fingerprints``: distinct values ``fp``.  Links (a, b) that join exactly the
    fingerprints connected by steps of at most ``bits`` differing bits (``bits`` even)."""
    if bits % 2 or bits < 0:
        raise ValueError("bits must be even")
    masks = _masks(bits)
    keyed = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
        for i, m in enumerate(masks)])).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["k", "v"]), "simhash-blocks")
    few = shared.where(F.col("n") <= pairs_up_to).drop("n")
    pairs = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["k", "v"])
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
             .select("a", "b"))
    many = shared.where(F.col("n") > pairs_up_to).drop("n")
    near = F.when(F.lit(False), F.array(F.col("fp")))
    for i, m in enumerate(masks):
        near = near.when(F.col("k") == i, _within(F.col("fp"), m, bits // 2))
    # at most all values so close to one value can meet here: a small, fixed number
    meets = (many.select("k", "v", "fp", F.explode(near).alias("z")).groupBy("k", "v", "z")
             .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))
    stars = meets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", pairs_up_to: int = 64) -> DataFrame:
    """One row per row of ``docs``: its id as ``doc_id``, ``text_hash`` (XXH64 of the text, tells
    rows of one id apart), ``fp``, ``root`` (the smallest fingerprint reachable) and
    ``component_id``, the smallest id reachable."""
    slim = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        fingerprinter(shingle)(F.col(text_col)).alias("fp")), "simhash")
    first = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(first.select("fp"), bits, pairs_up_to))
    rooted = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return slim.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex64(fp) -> Column:
    """16 lower-case hex digits of a 64-bit value."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` (columns doc_id and text among others) with one row of each component: that
    of the smallest doc_id, null last (of several texts with that id, the one of smallest
    hash; of rows equal in both, one)."""
    marked = near_duplicates(docs, shingle, bits)
    rows = marked.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    best = materialize(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("best"))
                       .select(F.col("best.doc_id").alias("__lm_id"), F.col("best.text_hash").alias("__lm_h"),
                               F.col("best.n").alias("__lm_n")), "simhash-kept")
    same = docs["doc_id"].eqNullSafe(best["__lm_id"]) & (F.xxhash64(docs["text"]) == best["__lm_h"])
    kept = docs.join(best.where("__lm_n = 1"), same, "left_semi")
    repeated = best.where("__lm_n > 1")
    if repeated.isEmpty():
        return kept
    once = (docs.withColumn("__lm_t", F.xxhash64("text")).join(repeated, same, "left_semi")
            .dropDuplicates(["doc_id", "__lm_t"]).select(*docs.columns))
    return kept.unionByName(once)
