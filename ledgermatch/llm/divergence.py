"""Source divergence audit: how far a source's vocabulary is from the other sources of its
language, and which terms it uses more than the language does.

Terms are runs of ASCII letters and code points above U+007F; only A-Z are lower-cased.  A
language keeps the V terms found in at least ``least_docs`` of its documents.  A group
(lang, source) gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the
sum of its counts of kept terms; a language does so with its own counts.

Counting: a task joins texts up to ``CHUNK`` bytes and counts them in numpy by length
buckets.  Terms up to 8 bytes become one uint64 word, up to 16 bytes two words; they are
radix-sorted by their 16-bit digits (stable passes, so that the documents of equal terms
stay in order), and runs give occurrences and documents.  Longer terms have a bucket for
each length, sorted as byte strings.  Only (lang, source, term, occurrences, documents)
leaves a chunk; Spark adds these up with map-side sums, so a hot source is many small
partial counts, never one group.

Distances: sum |p - q| over all kept terms needs no dense table.  Where neither source has
the term the difference is the constant of count 0; tiles of (term block x up to 256
sources x up to 256 sources) add the corrections where one of them has it.

All arithmetic is on integers (decimals where 10^9 x count passes 64 bits).

Defined results: null text, lang and source are ''; every row is a document, repeated rows
too; a group without terms has N = 0 and appears in part ``pair``; a language without kept
terms has value 0 throughout; a source alone in its language has no ``pair`` rows; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import ship
from ledgermatch.session import materialize

#: Bytes and documents that a task counts at once.
CHUNK, CHUNK_DOCS = 8 << 20, 60_000
#: Sides of a tile of the distance sums.
SOURCES, TERMS = 256, 2048

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = (((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_BYTES >= 0x80)).astype(np.int8)


def radix_order(digits: list[np.ndarray]) -> np.ndarray | None:
    """Stable order by columns of uint16, least significant first (numpy sorts uint16 by
    radix); None if all rows are equal."""
    order = None
    for d in digits:
        if len(d) and (d != d[0]).any():
            step = np.argsort(d if order is None else d[order], kind="stable")
            order = step if order is None else order[step]
    return order


def _word(text: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as a big-endian word, the first byte on top."""
    every = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    drop = (8 * (8 - length)).astype(np.uint64)
    return every[at].astype(np.uint64) >> drop << drop


def _digits(word: np.ndarray) -> list[np.ndarray]:
    return list(np.ascontiguousarray(word.astype("<u8").view("<u2").reshape(-1, 4).T))


def _runs(columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and distinct documents of each run of equal, sorted columns."""
    new = np.zeros(len(doc), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    seen = np.r_[np.cumsum(new), 0]
    ends = np.r_[first[1:], len(doc)]
    return first, ends - first, seen[ends - 1] - seen[first] + 1


def count_terms(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each (group, term): group, term, occurrences and documents.  ``group`` holds the
    uint16 group of each text."""
    text = _LOWER[np.frombuffer(b"\0".join([*texts, b"\0" * 16]), np.uint8)]
    edges = np.flatnonzero(np.diff(_INSIDE[text], prepend=np.int8(0)))  # the end is outside
    start, length = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    out = []  # per bucket: rows that begin a run, occurrences, documents
    buckets = [np.flatnonzero(length <= 8), np.flatnonzero((length > 8) & (length <= 16))]
    for words, rows in enumerate(buckets, 1):
        if len(rows):
            cols = [_word(text, start[rows] + 8 * k, np.minimum(length[rows] - 8 * k, 8)) for k in range(words)]
            g = group[doc[rows]]
            order = radix_order([d for c in reversed(cols) for d in _digits(c)] + [g])
            if order is not None:
                cols, g, rows = [c[order] for c in cols], g[order], rows[order]
            first, n, docs = _runs([*cols, g], doc[rows])
            out.append((rows[first], n, docs))
    long = np.flatnonzero(length > 16)
    long = long[np.argsort(length[long], kind="stable")]
    for rows in np.split(long, np.flatnonzero(np.diff(length[long])) + 1):
        if len(rows):
            wide = int(length[rows[0]])
            if len(rows) == 1:  # nothing to sort
                out.append((rows, np.ones(1, np.int64), np.ones(1, np.int64)))
                continue
            terms = text[start[rows][:, None] + np.arange(wide)].view(f"S{wide}").ravel()
            order = np.argsort(terms, kind="stable")
            order = order[np.argsort(group[doc[rows[order]]], kind="stable")]
            rows, terms = rows[order], terms[order]
            first, n, docs = _runs([terms, group[doc[rows]]], doc[rows])
            out.append((rows[first], n, docs))
    if not out:
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none
    rows, n, docs = (np.concatenate(x) for x in zip(*out))
    size = length[rows]
    ends = np.r_[0, np.cumsum(size)]
    data = text[np.repeat(start[rows] - ends[:-1], size) + np.arange(ends[-1])]
    terms = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return group[doc[rows]].astype(np.int64), terms.cast(pa.large_string()).cast(pa.string()), n, docs


COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _count(batches):
    texts: list[bytes] = []
    names: dict[tuple[str, str], int] = {}
    group: list[int] = []
    held = 0

    def flush():
        g, terms, n, docs = count_terms(texts, np.array(group, np.uint16))
        langs, sources = (pa.array(x, pa.string()) for x in zip(*names))
        for a in range(0, len(g), 100_000):
            some, at = slice(a, a + 100_000), pa.array(g[a:a + 100_000])
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms[some], pa.array(n[some], pa.int64()), pa.array(docs[some], pa.int64())],
                                             ["lang", "source", "term", "n", "docs"])

    for b in batches:
        lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
            texts.append(t)
            group.append(names.setdefault((lang[k], source[k]), len(names)))
            held += len(t)
            if held >= CHUNK or len(texts) >= CHUNK_DOCS:
                yield from flush()
                texts, names, group, held = [], {}, [], 0
    if texts:
        yield from flush()


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms of a table with lang, source and text."""
    ship()
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)); 0 if nothing is kept."""
    wide = "decimal(27,0)"
    return F.expr(f"if({kept} = 0, 0L, 1 + (1000000000BD * cast({count} + 5 as {wide})) div cast({total} + 5 * {kept} as {wide}))")


def _tile(head: pa.Table, rows: pa.Table) -> pa.Table:
    """Of each pair of sources: what the terms of this block add to V x |difference at count 0|."""
    h = head.to_pylist()[0]
    (ia, pa0), (ib, pb0) = ((np.array([s["id"] for s in h[x]]), np.array([s["none"] for s in h[x]], np.int64)) for x in ("left", "right"))
    term, t = np.unique(rows.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    src, p = rows.column("id").to_numpy(), rows.column("p").to_numpy()

    def dense(ids, none):
        m = np.repeat(none[:, None], len(term), axis=1)
        at = np.searchsorted(ids, src)
        mine = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == src)
        m[at[mine], t[mine]] = p[mine]
        return m

    a, b = dense(ia, pa0), dense(ib, pb0)
    sums = np.stack([np.abs(b - x).sum(axis=1) - len(term) * np.abs(pb0 - y) for x, y in zip(a, pa0)])
    k = sums.size
    return pa.table({"lang": pa.array([h["h_lang"]] * k, pa.string()), "a": pa.array(np.repeat(ia, len(ib)), pa.int64()),
                     "b": pa.array(np.tile(ib, len(ia)), pa.int64()), "part": pa.array(sums.ravel(), pa.int64())})


def _distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    groups = groups.withColumn("none", _share("0", "total", "kept"))
    blocks = groups.groupBy("lang", (F.expr(f"id div {SOURCES}")).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("id", "none"))).alias("ids"))
    pairs = blocks.alias("x").join(blocks.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.blk") <= F.col("y.blk"))).select(
        "x.lang", F.col("x.blk").alias("xb"), F.col("y.blk").alias("yb"), F.col("x.ids").alias("left"), F.col("y.ids").alias("right"))
    tiles = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.max(F.expr(f"id div {SOURCES}")).alias("top"))
    terms = rows.join(tiles, "lang").join(groups.select("lang", "source", "id"), ["lang", "source"]).select(
        "lang", F.expr(f"pmod(xxhash64(term), 1 + kept div {TERMS})").alias("tb"), F.expr(f"id div {SOURCES}").alias("blk"),
        F.explode(F.expr("sequence(0L, top)")).alias("with"), "id", "term", "p")
    key = ["lang", "tb", "xb", "yb"]
    terms = terms.select("lang", "tb", F.least("blk", "with").alias("xb"), F.greatest("blk", "with").alias("yb"), "id", "term", "p")
    heads = terms.select(*key).distinct().join(pairs, ["lang", "xb", "yb"])
    heads = heads.select("left", "right", *(F.col(c).alias(f"h_{c}") for c in key))
    parts = terms.groupBy(*key).cogroup(heads.groupBy(*(f"h_{c}" for c in key))).applyInArrow(
        lambda r, h: _tile(h, r), "lang string, a bigint, b bigint, part bigint")
    half = parts.where("a < b")  # within one block both orders are there
    sums = half.union(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part")).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    x, y = groups.alias("x"), groups.alias("y")
    every = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.id") != F.col("y.id"))).select(
        "x.lang", F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x.source", F.col("y.source").alias("item"),
        (F.col("x.kept") * F.abs(F.col("x.none") - F.col("y.none"))).alias("base"))
    return every.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce(sums["part"], F.lit(0))).cast("bigint").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank).  Part ``pair``: distance to each other source
    of the language.  Part ``term``: the terms that the source gives more than the language
    does, by the difference; ranks to ``top_terms``."""
    counts = materialize(group_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    rows = materialize(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-terms")
    langs = rows.groupBy("lang").agg(F.sum("n").alias("all_total"))
    langs = langs.join(rows.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("one").alias("kept")), "lang")
    there = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "all_total", "kept"])
    # one row a (lang, source)
    groups = materialize(groups.withColumn("id", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint")), "term-groups")
    rows = rows.join(groups.drop("id"), ["lang", "source"])
    rows = materialize(rows.select("lang", "source", "term", _share("n", "total", "kept").alias("p"), _share("all_n", "all_total", "kept").alias("q")), "term-shares")
    pairs = _distances(rows, groups)
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(w).cast("int").alias("rank")
    best = terms.select("*", rank).where(F.col("rank") <= top_terms)
    return pairs.select("*", rank).unionByName(best)
