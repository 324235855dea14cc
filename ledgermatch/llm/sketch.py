"""Document fingerprints: bottom-k sketches of word-shingle hashes (DataFrame functions only).

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes (as signed
longs) of a text's shingles: runs of ``shingle`` words, or the whole sequence if it is
shorter; no word, no shingle.  Sketches of parts merge (``merge``, ``merge_all``) into the sketch of
the whole, provided that the parts' shingles make up the whole's.  Two sketches estimate

- resemblance: of the k smallest hashes of their union, the share that both hold
  (two empty sketches: 1, one empty: 0),
- distinct shingles: exact below k, else from the k-th smallest hash,
- containment of a in b: resemblance times the distinct count of the union, over that of a.

Equal texts have equal sketches; null text is empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import words

SHINGLE = 5
K = 128
#: Rows with neighbours are laid out in ranges of about this many rows, or the square root of
#: their number if that is more (so the list of cuts stays a small part of the table).
ROWS_PER_RANGE = 4096
#: Rows a range that the cuts are taken from.
SAMPLED = 32
#: The hash from which a whole id lies above a cut.
LOWEST = -(1 << 63)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sketch of a text.  Words are hashed once; a shingle is the hash of its words' hashes
    (of their whole array where there are too few)."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        every = F.transform(F.sequence(F.lit(1), n - (shingle - 1)),
                            lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(shingle)]))
        return F.when(n >= shingle, every).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # one-element array: binds the word hashes once
    return bottom(F.flatten(F.transform(F.array(hashed), shingles)), k)


def merge(a, b, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(_column(a), _column(b))), 1, k)


def merge_all(parts: DataFrame, key: str, col: str, k: int = K) -> DataFrame:
    """Sketch of each key from the sketches of its parts.  Each round merges within random
    groups of at most about 64 parts, so that a key with any number of parts never meets
    in one task but as sketches of k values."""
    now = parts.select(F.col(key).alias(key), F.col(col).alias(col))
    most = now.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        groups = max(1, most // 64)
        now = (now.withColumn("__lm_g", F.pmod(F.xxhash64(col), F.lit(groups))).groupBy(key, "__lm_g")
               .agg(F.collect_set(col).alias(col))
               .select(key, bottom(F.flatten(col), k).alias(col)))
        if groups == 1:
            return now
        most = groups


def resemblance(a, b, k: int = K) -> Column:
    a, b = _column(a), _column(b)
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a, k: int = K) -> Column:
    a = _column(a)
    # the k-th smallest of n even draws from 2**64 values lies near k * 2**64 / n
    spot = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spot)


def containment(a, b, k: int = K) -> Column:
    """Share of a's shingles that b has (a without shingles: 1)."""
    a, b = _column(a), _column(b)
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def to_text(a) -> Column:
    """A sketch as text: 16 hex digits a hash, ascending."""
    return F.array_join(F.transform(_column(a), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _key(doc_id: Column, h: Column) -> Column:
    """The order of rows: null ids first, then ids, rows of one id by a hash of their text."""
    return F.struct(doc_id.isNotNull().cast("int").alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), h.alias("h"))


def _table(cuts: list[tuple]) -> Column:
    """Cuts as one constant array of keys."""
    part = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    known, ids, hashes = [int(i is not None) for i, _ in cuts], [i or 0 for i, _ in cuts], [h for _, h in cuts]
    return F.arrays_zip(part(known), part(ids), part(hashes)).cast("array<struct<known:int,id:bigint,h:bigint>>")


def _place(cuts: list[tuple], key: Column) -> Column:
    """How many of the sorted cuts are not above the key, by halves."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, b: n + F.when(F.get(_table(cuts), n + b - 1) <= key, b).otherwise(F.lit(0)))


def _evenly(values: Column, parts: Column) -> Column:
    """The values that cut a sorted array into so many parts."""
    return F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(
        values, F.floor(i * F.size(values) / parts).cast("int")))).otherwise(F.array().cast("array<bigint>"))


def find_cuts(d: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> tuple[list[tuple], int | None]:
    """(cuts, first id): keys (id, hash) that cut rows ``doc_id, text`` into even ranges, from a
    sample in proportion to the number of ranges.  An id (or null) that holds more than a
    range is cut by the hashes of its texts, too.  Every range holds rows: its cut is a key
    that occurs, and a hash that cuts lies above another one of its id."""
    n, nulls, least = d.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    size = max(rows_per_range, int(n ** 0.5))
    chosen = F.rand(11) < min(1.0, SAMPLED / size)
    first = None if nulls else least
    ranges = -(-(n - nulls) // size)
    found = []
    if ranges > 1:
        found = d.select("doc_id").where(chosen).agg(F.sort_array(F.collect_list("doc_id")).alias("a")).select(
            _evenly(F.col("a"), F.lit(ranges))).first()[0]
    parts = {i: 0 for i in found if i is not None}
    for i in found:
        if i is not None:
            parts[i] += 1
    # an id that is a cut again and again begins at the first and is cut by hash at the others
    hot = {i: k for i, k in parts.items() if k > 1} | ({None: -(-nulls // size)} if nulls > size else {})
    cuts = {(i, LOWEST) for i in parts if i != first or nulls} | ({(least, LOWEST)} if nulls and nulls < n else set())
    if hot:
        wanted = d.sparkSession.createDataFrame(list(hot.items()), "id bigint, parts int")
        hashes = (d.where(chosen).join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")))
                  .groupBy("id", "parts").agg(F.sort_array(F.collect_list(F.xxhash64("text"))).alias("a")))
        for r in hashes.select("id", F.get("a", F.lit(0)).alias("low"), _evenly(F.col("a"), F.col("parts")).alias("cut")).collect():
            cuts |= {(r["id"], h) for h in r["cut"] if h is not None and h > r["low"]}
    return sorted(cuts, key=lambda c: (c[0] is not None, c[0] or 0, c[1])), first


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) in the order of id, null ids first (rows
    of one id by the hash of their text); the last row's next is the first row.  Null texts
    are empty.

    Texts are shuffled once, to ranges of (id, hash of text); a range is sorted on its own
    and no task sees all rows, also if one id holds most of them.  The first row of each
    range also goes to the end of the range before it (the very first to the last range), so
    that every row finds its next one in its own range.  Only rows equal in id and in text
    always share a range."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    cuts, first = find_cuts(d, rows_per_range)
    by_hash = any(h != LOWEST for _, h in cuts)
    d = d.withColumn("h", F.xxhash64("text"))
    d = d.withColumn("place", _place(cuts, _key(F.col("doc_id"), F.col("h") if by_hash else F.lit(0).cast("bigint"))).cast("int"))
    # a range but the first begins with its cut, whose key occurs
    starts = _table([(first, LOWEST), *cuts])
    begins = F.get(starts, F.col("place"))
    heads = (d.where((begins["known"] == F.col("doc_id").isNotNull().cast("int")) & (begins["id"] == F.coalesce("doc_id", F.lit(0)))
                     & ((begins["h"] == LOWEST) | (begins["h"] == F.col("h"))))
             .groupBy("place").agg(F.min(F.struct("h", "text")).alias("head"), F.first("doc_id").alias("doc_id")))
    before = F.when(F.col("place") > 0, F.col("place") - 1).otherwise(F.lit(len(cuts)))
    guards = heads.select("doc_id", F.col("head")["text"].alias("text"), F.col("head")["h"].alias("h"),
                          before.alias("place"), F.lit(1).alias("late"))
    laid = d.withColumn("late", F.lit(0)).unionByName(guards).repartitionById(len(cuts) + 1, F.col("place"))
    w = Window.partitionBy("place").orderBy("late", F.col("doc_id").asc_nulls_first(), "h", "text")
    return (laid.withColumn("sketch", sketch("text", k, shingle))
            .select("*", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
            .where("late = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                  shingle: int = SHINGLE) -> DataFrame:
    """For every row: its sketch, its edited text (the last half of its code points replaced
    by the first as many, or all, of the next row's), that text's sketch, and the
    resemblance of the text's sketch to the edited text's and to the next row's."""
    d = with_next(docs, id_col, text_col, k, shingle)
    half = F.floor(F.length("text") / 2).cast("int")
    return (d.withColumn("n_chars", F.length("text").cast("bigint"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                                           F.substring("next_text", F.lit(1), half)))
            .withColumn("edited_sketch", sketch("edited", k, shingle))
            .withColumn("near_edited", resemblance("sketch", "edited_sketch", k))
            .withColumn("near_next", resemblance("sketch", "next_sketch", k)))
