"""Mixing sources to target weights by hash thresholds (DataFrame functions only).

Sources, by code point with null last, weigh ``weights`` in turn.  They share the total
size by weight; a target stops at ``most`` times its source's size and what is above is
shared among the others by weight until no target is above.

A source takes every row ``floor(target / size)`` times, and once more the rows whose hash
is not above a threshold, chosen so that their sizes come nearest to what is missing.  The
threshold comes from histograms instead of a sort: sizes are summed by source and the
leading bits of the hash, the bucket in which the missing size is passed is found, and only
that bucket is summed again by the bits that follow, until it holds one hash value.  Rows
are then filtered by comparing their hash.  A row's hash depends on its id and text alone,
so reruns agree and a larger threshold keeps what a smaller one kept.

Defined results: null text has size 0; null is a source of its own; rows equal in id and
text are taken alike; sources of size 0 have target 0 and are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import WORD_RE, key_of
from ledgermatch.operators.ordering import with_row_index
from ledgermatch.session import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
HASH_BITS = 60
#: Bits of one histogram: at most 2**12 rows a source and level.
LEVEL_BITS = 12


def size_of(text) -> Column:
    """Number of words (runs of anything but ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def hash_of(doc_id, text, salt: str) -> Column:
    """60 bits that depend on id and text alone."""
    said = F.concat(F.lit(salt + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"),
                    F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with ``target``.

    Sources are numbered without sorting them in one task.  In each round the sources that
    have not stopped share what the stopped ones leave; those whose share is above their
    stop join them.  Only sums reach the driver."""
    s = with_row_index(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    s = materialize(s.select("source", "source_size", weight.cast("bigint").alias("weight"),
                             (F.col("source_size") * most).alias("stop")), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        stops = F.lit(level) * F.col("weight") > F.col("stop")
        n, above, free = s.agg(F.count_if(stops), F.sum(F.when(stops, F.col("stop"))),
                               F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, max(level, (total - (above or 0)) / free)
    share = F.least(F.col("stop").cast("double"), F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", share.alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """``slim`` (key, size, hash), ``budgets`` (key, missing: the size to reach).  Returns
    (key, threshold): rows with hash <= threshold come nearest to the missing size."""
    open_, done = budgets.select("key", "missing", F.lit(0).cast("bigint").alias("prefix"),
                                 F.lit(0).cast("bigint").alias("taken")), None
    bits = 0
    while bits < HASH_BITS:
        step = min(LEVEL_BITS, HASH_BITS - bits)
        left = HASH_BITS - bits - step
        # the rows of the open bucket, summed by the bits that follow its prefix
        rows = slim.join(open_, "key").where(F.shiftright("hash", left + step) == F.col("prefix"))
        hist = rows.groupBy("key", "missing", "taken", F.shiftright("hash", left).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        w = Window.partitionBy("key").orderBy("bucket")
        run = hist.withColumn("upto", F.col("taken") + F.sum("size").over(w))
        # the bucket in which the missing size is passed: the first that reaches it
        first = materialize(run.where(F.col("upto") >= F.col("missing")).groupBy("key", "missing").agg(
            F.min(F.struct("bucket", "upto", "size", "lo", "hi")).alias("b")).select(
            "key", "missing", "b.*", (F.col("b.upto") - F.col("b.size")).alias("under")), "mix-buckets")
        last = first.where(F.col("lo") == F.col("hi"))
        # one hash value: with it or without it, whichever is nearer
        nearer = F.when(F.col("upto") - F.col("missing") < F.col("missing") - F.col("under"), F.col("hi")).otherwise(F.col("lo") - 1)
        found = last.select("key", nearer.alias("threshold"))
        done = found if done is None else done.union(found)
        rest = first.where(F.col("lo") < F.col("hi"))
        bits += step
        if rest.isEmpty():
            break
        open_ = rest.select("key", "missing", F.col("bucket").alias("prefix"), F.col("under").alias("taken"))
    return done


def plan(docs: DataFrame, salt: str = "mix", weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The slim table (doc_id, source, key, size, hash) and one row a source: key,
    source_size, target, whole (copies of every row) and threshold (null: no more)."""
    slim = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key_of(source_col).alias("key"),
        size_of(text_col).alias("size"), hash_of(id_col, text_col, salt).alias("hash")), "mix-sizes")
    per = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    per = materialize(per.select(key_of("source").alias("key"), "source_size", "target", whole.alias("whole")), "mix-targets")
    missing = F.least(F.col("target") - F.col("whole") * F.col("source_size"), F.col("source_size"))
    cut = thresholds(slim, per.select("key", missing.alias("missing")).where("missing > 0"))
    return slim, materialize(per.join(cut, "key", "left"), "mix-plan")


def _times(hash_col) -> Column:
    return F.col("whole") + (F.coalesce(hash_col <= F.col("threshold"), F.lit(False))).cast("bigint")


def take_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times (how
    often the mix takes the row) and taken (words)."""
    slim, per = plan(docs, **options)
    return slim.join(per, "key").withColumn("times", _times(F.col("hash"))).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, salt: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    _, per = plan(docs, salt=salt, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    per = per.select(F.col("key").alias("__lm_key"), F.col("whole").alias("__lm_whole"), F.col("threshold").alias("__lm_cut"))
    marked = docs.withColumn("__lm_k", key_of(source_col)).join(per, F.col("__lm_k") == F.col("__lm_key"))
    times = F.col("__lm_whole") + F.coalesce(hash_of(id_col, text_col, salt) <= F.col("__lm_cut"), F.lit(False)).cast("bigint")
    copies = marked.withColumn("__lm_times", times).where("__lm_times > 0")
    return copies.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__lm_times").cast("int"))).alias("__lm_copy")).drop("__lm_copy")
