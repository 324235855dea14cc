"""Candidate generation for the two theta joins, as equi-joins (no cross join).

Every generator here is *lossless* for the predicate it serves; the exact predicate is
applied afterwards.

Fuzzy tier, ``score >= c`` (edit ratio, plain or token-sorted)
    ``ratio >= c`` allows at most ``k(L) = floor(L (201 - 2c) / 200)`` edits, L the
    longer length, and needs ``|n - m| <= k``.  Cut the *longer* string into k+1
    segments: at least one survives unedited and moves by at most k positions.  The
    longer side is indexed by ``(length, segment no, segment text)``; the shorter side
    probes every feasible longer length and the substrings in the shift window
    (pigeonhole / segment filtering).  Both directions are run, so whichever side
    is longer is the one that is segmented.

Fuzzy tier, code parity (best candidate whatever the score)
    A candidate must share a 3-character run; pairs are produced by an equi-join on
    distinct 3-grams and each pair is kept once.

Substring tier
    Prefix filtering on words ordered by (document frequency, word): containment needs
    the contained side's rarest qualifying word; two shared words need a shared word
    outside each side's most frequent one (vendors with a repeated word use all their
    words); the affix rule needs the same first / last 8 characters.  All rules give keys of
    one kind, a rule letter and a text, so that one equi-join serves them all.

Hot keys
    A key held by v vendors and s suppliers makes v * s pairs, however few bytes that is, so
    adaptive execution does not split it.  ``keyed_pairs`` cuts such a key into a grid of
    cells of at most ``PAIRS_PER_CELL`` pairs, each a join key of its own; the pairs are the
    same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.text import (MIN_WORD_LEN, STOP_WORDS, drop_stop_words, ngrams,
                                        qualifying_words, words)
from ledgermatch.session import materialize

# Below this threshold segments get short (2-3 characters) and the probe count grows, so
# the 3-gram join (also lossless: a shared 3-character run is required) is cheaper.
SEGMENT_MIN_SCORE = 75
# Pairs that one join key may make before it is cut into cells.
PAIRS_PER_CELL = 1 << 22


def _k(length_sql: str, c: int) -> str:
    return f"(({length_sql}) * {201 - 2 * c}) div 200"


def _segment(m: str, i: str, c: int) -> tuple[str, str]:
    """(start, length) SQL of segment ``i`` when a length-``m`` string is cut into k(m)+1."""
    parts = f"({_k(m, c)} + 1)"
    base = f"({m} div {parts})"
    nshort = f"({parts} - ({m} % {parts}))"
    start = f"({i} * {base} + greatest(0, {i} - {nshort}))"
    seglen = f"({base} + if({i} >= {nshort}, 1, 0))"
    return start, seglen


def segment_index(df: DataFrame, key: str, text: str, c: int) -> DataFrame:
    """Longer side: one row per (key, length, segment no, segment text)."""
    n = f"length({text})"
    start, seglen = _segment(n, "i", c)
    seg = F.expr(f"transform(sequence(0, {_k(n, c)}), i -> named_struct("
                 f"'i', i, 'g', substring({text}, {start} + 1, {seglen})))")
    return (df.select(key, F.length(text).alias("seg_len"), F.explode(seg).alias("s"))
            .select(key, "seg_len", F.col("s.i").alias("seg_no"), F.col("s.g").alias("seg_text")))


def segment_probes(df: DataFrame, key: str, text: str, c: int, strictly_longer: bool) -> DataFrame:
    """Shorter side: one row per (key, partner length, segment no, probed substring)."""
    n = f"length({text})"
    lo = f"{n} + 1" if strictly_longer else n
    hi = f"(200 * {n}) div {2 * c - 1}"
    start, seglen = _segment("m", "i", c)
    k = _k("m", c)
    qlo = f"greatest(0, {start} - {k})"
    qhi = f"least({n} - {seglen}, {start} + {k})"
    expr = (
        f"flatten(transform(if({lo} <= {hi}, sequence({lo}, {hi}), array()), m -> "
        f"flatten(transform(sequence(0, {k}), i -> "
        f"transform(if({qlo} <= {qhi}, sequence({qlo}, {qhi}), array()), q -> "
        f"named_struct('m', m, 'i', i, 'g', substring({text}, q + 1, {seglen})))))))")
    # duplicate probes only repeat a candidate pair, which the pair de-duplication drops
    return (df.select(key, F.explode(F.expr(expr)).alias("p"))
            .select(key, F.col("p.m").alias("seg_len"), F.col("p.i").alias("seg_no"),
                    F.col("p.g").alias("seg_text")))


def _segment_pairs(vendors: DataFrame, suppliers: DataFrame, vtext: str, stext: str,
                   c: int) -> DataFrame:
    on = ["seg_len", "seg_no", "seg_text"]
    # supplier is the longer (or equal) side
    a = segment_index(suppliers, "supplier_norm", stext, c).join(
        segment_probes(vendors, "vendor_norm", vtext, c, strictly_longer=False), on)
    # vendor is strictly longer
    b = segment_index(vendors, "vendor_norm", vtext, c).join(
        segment_probes(suppliers, "supplier_norm", stext, c, strictly_longer=True), on)
    return a.select("vendor_norm", "supplier_norm").unionByName(b.select("vendor_norm", "supplier_norm"))


def threshold_candidates(vendors: DataFrame, suppliers: DataFrame, c: int) -> DataFrame:
    """Lossless candidates for ``similarity >= c``: plain and token-sorted segment joins.
    Below ``SEGMENT_MIN_SCORE`` the 3-gram join is used instead; it is lossless for
    ``similarity >= c`` *and a shared 3-character run*, the fuzzy tier's full condition.

    ``vendors`` needs ``vendor_norm, vendor_sorted``; ``suppliers`` needs
    ``supplier_norm, supplier_sorted``.  Pairs may repeat.
    """
    if c < SEGMENT_MIN_SCORE:
        return ngram_candidates(vendors, suppliers)
    return _segment_pairs(vendors, suppliers, "vendor_norm", "supplier_norm", c).unionByName(
        _segment_pairs(vendors, suppliers, "vendor_sorted", "supplier_sorted", c))


def keyed_pairs(vendor_keys: DataFrame, supplier_keys: DataFrame,
                pairs_per_cell: int | None = None) -> DataFrame:
    """All (vendor_norm, supplier_norm) that have a key ``g`` in common; pairs may repeat.

    A key of more than ``pairs_per_cell`` pairs is cut into vendor parts times supplier
    parts by hash; each row goes to every cell of its part."""
    pairs_per_cell = PAIRS_PER_CELL if pairs_per_cell is None else pairs_per_cell
    side = max(1, int(pairs_per_cell ** 0.5))
    sizes = (vendor_keys.groupBy("g").agg(F.count(F.lit(1)).alias("nv"))
             .join(supplier_keys.groupBy("g").agg(F.count(F.lit(1)).alias("ns")), "g"))
    hot = materialize(sizes.where(F.col("nv") * F.col("ns") > pairs_per_cell).select(
        "g", F.ceil(F.col("nv") / side).cast("int").alias("pv"), F.ceil(F.col("ns") / side).cast("int").alias("ps")),
        "hot-keys")
    if hot.isEmpty():
        return vendor_keys.join(supplier_keys, "g").select("vendor_norm", "supplier_norm")

    def cells(keys: DataFrame, name: str, own: str, other: str) -> DataFrame:
        parts = lambda c: F.coalesce(F.col(c), F.lit(1))
        return (keys.join(hot, "g", "left")
                .withColumn(f"c_{own}", F.pmod(F.xxhash64(name), parts(own)).cast("int"))
                .withColumn(f"c_{other}", F.explode(F.sequence(F.lit(0), parts(other) - 1)))
                .select("g", name, "c_pv", "c_ps"))

    return (cells(vendor_keys, "vendor_norm", "pv", "ps").join(cells(supplier_keys, "supplier_norm", "ps", "pv"),
                                                               ["g", "c_pv", "c_ps"])
            .select("vendor_norm", "supplier_norm"))


def ngram_candidates(vendors: DataFrame, suppliers: DataFrame, n: int = 3,
                     pairs_per_cell: int | None = None) -> DataFrame:
    """All pairs sharing a character n-gram, each pair once: a join on distinct n-grams, then
    a hash de-duplication whose partial aggregation runs map-side."""
    ve = vendors.select("vendor_norm", F.explode(ngrams("vendor_norm", n)).alias("g"))
    se = suppliers.select("supplier_norm", F.explode(ngrams("supplier_norm", n)).alias("g"))
    return keyed_pairs(ve, se, pairs_per_cell).dropDuplicates()


# ---------------------------------------------------------------- substring tier

def word_frequencies(vendors: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Document frequency of every word over the distinct vendor and supplier names."""
    names = (vendors.select(F.col("vendor_norm").alias("name"))
             .unionByName(suppliers.select(F.col("supplier_norm").alias("name"))).distinct())
    return (names.select(F.explode(F.array_distinct(words("name"))).alias("w"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("df")))


def _rules(df: DataFrame, key: str, wf: DataFrame, contained: str, holds: str, shared) -> DataFrame:
    """(key, g): the keys of each name.  ``contained`` and ``holds`` are the rule letters for
    its rarest qualifying word and for all its words; ``shared`` gives (letter, words) of
    the shared-words rule from the meaningful words, rarest first, and from those in text
    order.  A group is one name, so its word list stays small."""
    ex = df.select(key, F.explode(F.array_distinct(words(key))).alias("w")).join(wf, "w")
    one = ex.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "w")))["w"].alias("ws"))
    qualifying = F.filter("ws", lambda w: F.length(w) >= MIN_WORD_LEN)
    ranked, in_text = drop_stop_words(qualifying), drop_stop_words(qualifying_words(key))
    span = 2 * MIN_WORD_LEN
    ends = F.when(F.length(key) >= span, F.array(
        F.concat(F.lit("h"), F.substring(key, 1, span)), F.concat(F.lit("t"), F.substring(key, -span, span))))
    none = F.array().cast("array<string>")

    def tag(letter: str, ws):
        return F.transform(F.coalesce(ws, none), lambda x: F.concat(F.lit(letter), x))

    tagged = [tag(t, w) for t, w in [(holds, F.col("ws")), (contained, F.slice(qualifying, 1, 1)),
                                     *shared(ranked, in_text)]]
    return one.select(key, F.explode(F.concat(*tagged, F.coalesce(ends, none))).alias("g"))


def substring_candidates(vendors: DataFrame, suppliers: DataFrame, wf: DataFrame | None = None,
                         pairs_per_cell: int | None = None) -> DataFrame:
    """Lossless candidate pairs for the substring-tier predicate (pairs may repeat).  Any
    word frequencies that cover both sides are right; ``wf`` hands over known ones."""
    if wf is None:
        wf = word_frequencies(vendors, suppliers)

    def of_vendor(ranked, in_text):
        several = F.size(F.array_distinct(in_text)) < F.size(in_text)
        return [("p", F.when(~several & (F.size(in_text) >= 2), F.slice(ranked, 1, F.size(ranked) - 1))),
                ("d", F.when(several, ranked))]

    def of_supplier(ranked, in_text):
        two = F.size(in_text) >= 2
        return [("p", F.when(two, F.slice(ranked, 1, F.size(ranked) - 1))), ("d", F.when(two, ranked))]

    # "v": the vendor's rarest word among the supplier's words, "s": the other way round
    ve = _rules(vendors.select("vendor_norm"), "vendor_norm", wf, "v", "s", of_vendor)
    se = _rules(suppliers.select("supplier_norm"), "supplier_norm", wf, "s", "v", of_supplier)
    return keyed_pairs(materialize(ve, "vendor-word-keys"), materialize(se, "supplier-word-keys"), pairs_per_cell)


def _marks(a: list[list], b: list[list], weight=None) -> np.ndarray:
    """Per pair of rows, the number of keys of the row of ``a`` (times their ``weight`` there)
    that the row of ``b`` holds, too; keys of a row are distinct."""
    la: dict = {}
    lb: dict = {}
    for side, lists in ((a, la), (b, lb)):
        for i, keys in enumerate(side):
            for k in keys:
                lists.setdefault(k, []).append(i)
    out = np.zeros((len(a), len(b)), np.float32)
    for k in la.keys() & lb.keys():
        n = 1 if weight is None else np.array([weight[i][k] for i in la[k]], np.float32)[:, None]
        out[np.ix_(la[k], lb[k])] += n
    return out


def substring_mask(vendors: list[str], suppliers: list[str]) -> np.ndarray:
    """Pairs that can fulfil the substring-tier predicate: its rules on whole words, but for
    the order of the words that one name contains of the other."""
    def of(names: list[str]):
        ws = [[w for w in n.split(" ") if len(w) >= MIN_WORD_LEN] for n in names]
        meant = [[w for w in x if w not in STOP_WORDS] for x in ws]
        ends = [[("h", n[:span]), ("t", n[-span:])] if len(n) >= span and x else [] for n, x in zip(names, ws)]
        return [list(set(x)) for x in ws], meant, ends, np.array([len(n) for n in names])

    span = 2 * MIN_WORD_LEN
    (vq, vm, ve, vl), (sq, sm, se, sl) = of(vendors), of(suppliers)
    counts = [{w: x.count(w) for w in x} for x in vm]
    two = np.ix_([len(x) >= 2 for x in vm], [len(x) >= 2 for x in sm])
    out = _marks(ve, se) > 0
    out[two] |= _marks([list(x) for x in counts], [list(set(x)) for x in sm], counts)[two] >= 2
    both = _marks(vq, sq)
    nv, ns = (np.array([len(x) for x in q])[axis] for q, axis in ((vq, np.s_[:, None]), (sq, np.s_[None, :])))
    contained = ((both == ns) & (vl[:, None] > sl[None, :])) | ((both == nv) & (sl[None, :] > vl[:, None]))
    return out | (contained & (nv > 0) & (ns > 0))
