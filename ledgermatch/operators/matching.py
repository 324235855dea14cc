"""Vendor -> supplier record linkage: exact, substring and fuzzy tiers.

Matching runs once per *distinct vendor norm* (across all sheets), not per row.  A
tier's output ("decisions") has one row per vendor norm:
``vendor_norm, supplier_norm, supplier_pos, supplier, match_type, score``.

Ties between candidates: highest score, then the supplier that appears first in the
master.  Null/blank suppliers and names normalising to '' are never match targets
(declared deviations V4, V9).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.scoring import (Scorer, max_edits, ratio_from_distance, similarity,
                                           token_sort)
from ledgermatch.functions.text import is_blank, normalize_name, shares_ngram, smart_substring_match
from ledgermatch.operators import blocking, bounded
from ledgermatch.session import materialize

DECISION_COLS = ["vendor_norm", "supplier_norm", "supplier_pos", "supplier", "match_type", "score"]
TIERS = ("exact", "substring", "fuzzy")
# Thresholds of the selective passes before a search for the best partner at any score (any
# falling thresholds keep it exact).
PARITY_STEPS = (90,)
# Up to this many vendors x suppliers (some minutes of one core) bounds are counted for all of
# them; beyond, the segment join comes first.  Both ways find the same.
PAIRS_BY_BOUNDS = 1 << 31


def supplier_index(master: DataFrame) -> DataFrame:
    """A2: distinct supplier norms with their first master row (first row wins)."""
    named = (master.where(~is_blank("supplier"))
             .select("row_pos", "supplier", normalize_name("supplier").alias("supplier_norm"))
             .where(F.col("supplier_norm") != ""))
    return named.groupBy("supplier_norm").agg(
        F.min(F.struct("row_pos", "supplier")).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
    ).select("supplier_norm", F.col("first.row_pos").alias("supplier_pos"),
             F.col("first.supplier").alias("supplier"), "n_rows")


def vendor_keys(blocks: DataFrame) -> DataFrame:
    """Distinct vendor norms to be matched (the empty norm never matches)."""
    return blocks.select("vendor_norm").where(F.col("vendor_norm") != "").distinct()


def match_exact(keys: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Equality after normalisation; score 100."""
    return (keys.join(suppliers, keys.vendor_norm == suppliers.supplier_norm, "inner")
            .select(keys.vendor_norm, "supplier_norm", "supplier_pos", "supplier",
                    F.lit("exact").alias("match_type"), F.lit(100).alias("score")))


def residual(keys: DataFrame, decided: DataFrame) -> DataFrame:
    """Vendor norms without a decision yet."""
    return keys.join(decided.select("vendor_norm"), "vendor_norm", "left_anti")


def _best(scored: DataFrame, match_type: str) -> DataFrame:
    """Top-1 per vendor by (score desc, supplier_pos asc); partial aggregation map-side."""
    best = scored.groupBy("vendor_norm").agg(F.max(F.struct(
        F.col("score"), (-F.col("supplier_pos")).alias("neg_pos"), "supplier_norm", "supplier_pos",
        "supplier")).alias("b"))
    return best.select("vendor_norm", "b.supplier_norm", "b.supplier_pos", "b.supplier",
                       F.lit(match_type).alias("match_type"), F.col("b.score").alias("score"))


def _score(pairs: DataFrame, suppliers: DataFrame, scorer: Scorer, min_score: int | None,
           min_shared_run: int) -> DataFrame:
    p = pairs.join(suppliers.select("supplier_norm", "supplier_pos", "supplier"), "supplier_norm")
    p = p.select("*", scorer(F.col("vendor_norm"), F.col("supplier_norm")).alias("score"))
    keep = shares_ngram("vendor_norm", "supplier_norm", min_shared_run)
    if min_score is not None:
        keep = keep & (F.col("score") >= min_score)
    return p.where(keep)


def _score_banded(pairs: DataFrame, v: DataFrame, s: DataFrame, min_score: int) -> DataFrame:
    """Default scorer restricted to ``score >= min_score``: distinct candidate pairs,
    banded Levenshtein (stops past the allowed edit count) on the plain and the
    token-sorted names, and the 3-character-run condition."""
    p = (materialize(pairs.dropDuplicates(["vendor_norm", "supplier_norm"]), "fuzzy-candidates")
         .join(v, "vendor_norm").join(s, "supplier_norm"))
    longest = F.greatest(F.length("vendor_norm"), F.length("supplier_norm"))
    p = p.select("*", longest.alias("_len"), max_edits(longest, min_score).alias("_k"))

    def ratio(a, b):
        d = F.expr(f"levenshtein({a}, {b}, _k)")
        return F.when(d >= 0, ratio_from_distance(d, F.col("_len")))

    score = F.greatest(ratio("vendor_norm", "supplier_norm"), ratio("vendor_sorted", "supplier_sorted"))
    p = p.select("vendor_norm", "supplier_norm", "supplier_pos", "supplier", score.alias("score"))
    return p.where(F.col("score").isNotNull() & shares_ngram("vendor_norm", "supplier_norm", 3))


def _score_full(pairs: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """Default scorer on candidate pairs (no further filter is applied here); the
    token-sorted names are computed once per name, not once per pair."""
    p = pairs.join(v, "vendor_norm").join(s, "supplier_norm")
    longest = F.greatest(F.length("vendor_norm"), F.length("supplier_norm"))
    score = F.greatest(
        ratio_from_distance(F.levenshtein("vendor_norm", "supplier_norm"), longest),
        ratio_from_distance(F.levenshtein("vendor_sorted", "supplier_sorted"), longest))
    return p.select("vendor_norm", "supplier_norm", "supplier_pos", "supplier", score.alias("score"))


def match_fuzzy(keys: DataFrame, suppliers: DataFrame, min_score: int | None = None,
                scorer: Scorer = similarity, min_shared_run: int = 3,
                steps=None) -> DataFrame:
    """Best fuzzy candidate per vendor norm.

    ``min_score=None`` (code parity): the best candidate sharing a ``min_shared_run``
    run is accepted whatever its score.  Where there are many names, vendors with a candidate
    at or above one of the falling thresholds ``steps`` are settled by the selective segment
    join first; the rest go through the search by bounds (``operators.bounded``).
    ``min_score=c``: only candidates scoring ``>= c`` (the documented 85 % contract), by bounds
    or, where there are many names, the segment join.
    Segment blocking assumes the default edit-ratio scorer; another ``scorer`` uses the
    bounds that it declares, or, without any, the 3-gram join, which is lossless for any scorer.
    """
    v = keys.select("vendor_norm", token_sort("vendor_norm").alias("vendor_sorted"))
    s = suppliers.select("supplier_norm", token_sort("supplier_norm").alias("supplier_sorted"),
                         "supplier_pos", "supplier")
    bound = getattr(scorer, "bound", None)
    if scorer is similarity and min_shared_run == 3:
        sizes = v.count(), s.count()
        few = sizes[0] * sizes[1] <= PAIRS_BY_BOUNDS
        if min_score is None:
            steps = steps if steps is not None else () if few else PARITY_STEPS
            done, rest = _settled(v, s, steps)
            pairs = bounded.pairs_to_score(rest, s, bound, 3, None, lambda p: _score_full(p, v, s), None if steps else sizes)
            return reduce(DataFrame.unionByName, [*done, _best(_score_full(pairs, v, s), "fuzzy")])
        if min_score >= blocking.SEGMENT_MIN_SCORE and not few:
            return _best(_score_banded(blocking.threshold_candidates(v, s, min_score), v, s, min_score), "fuzzy")
        pairs = bounded.pairs_to_score(v, s, bound, 3, min_score, None, sizes)
        return _best(_score_full(pairs, v, s).where(F.col("score") >= min_score), "fuzzy")
    if bound is None:
        return _best(_score(blocking.ngram_candidates(v, s, min_shared_run), s, scorer, min_score, min_shared_run), "fuzzy")
    score = lambda p: _score(p, s, scorer, min_score, min_shared_run)
    return _best(score(bounded.pairs_to_score(v, s, bound, min_shared_run, min_score, score)), "fuzzy")


def _settled(v: DataFrame, s: DataFrame, steps, match_type: str = "fuzzy", holds=None) -> tuple[list[DataFrame], DataFrame]:
    """The best partners of the vendors that have one at or above a threshold of ``steps``
    (``holds``: a further condition on the pair), a table for each step, and the vendors left.

    The segment join finds every pair at or above its threshold, so the best of them is the
    best of all."""
    done, rest = [], v
    for c in steps:
        scored = _score_banded(blocking.threshold_candidates(rest, s, c), rest, s, c)
        found = materialize(_best(scored if holds is None else scored.where(holds), match_type), f"{match_type}-at-{c}")
        done.append(found)
        rest = materialize(rest.join(found.select("vendor_norm"), "vendor_norm", "left_anti"), f"{match_type}-below-{c}")
    return done, rest


def substring_pairs(keys: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every (vendor norm, supplier norm) pair for which the substring predicate holds.

    Where vendors x suppliers are not too many, they meet in tiles, which give each candidate
    once, without a shuffle of pairs; else in a join on words, whose pairs are then made distinct."""
    v, s = (d.select(c).where(F.col(c).isNotNull()).distinct() for d, c in ((keys, "vendor_norm"), (suppliers, "supplier_norm")))
    sizes = v.count(), s.count()
    if sizes[0] * sizes[1] <= PAIRS_BY_BOUNDS:
        return bounded.masked_pairs(v, s, blocking.substring_mask, sizes).where(smart_substring_match("vendor_norm", "supplier_norm"))
    cand = blocking.substring_candidates(v, s)
    return cand.dropDuplicates(["vendor_norm", "supplier_norm"]).where(smart_substring_match("vendor_norm", "supplier_norm"))


def match_substring(keys: DataFrame, suppliers: DataFrame, scorer: Scorer = similarity, steps=(90,)) -> DataFrame:
    """J5 top-1: among substring-predicate partners, highest score then first supplier.

    With the default scorer, names that fulfil the predicate always share a 3-character run,
    so the best is searched by bounds.  Where there are many names, vendors with such a
    partner at or above a threshold of ``steps`` are settled by the segment join; only the
    rest go through the word blocking."""
    if scorer is similarity:
        v = keys.select("vendor_norm", token_sort("vendor_norm").alias("vendor_sorted"))
        s = suppliers.select("supplier_norm", token_sort("supplier_norm").alias("supplier_sorted"),
                             "supplier_pos", "supplier")
        holds, sizes = smart_substring_match("vendor_norm", "supplier_norm"), (v.count(), s.count())
        if sizes[0] * sizes[1] <= PAIRS_BY_BOUNDS:
            score = lambda p: _score_full(p.where(holds), v, s)
            return _best(score(bounded.pairs_to_score(v, s, similarity.bound, 3, None, score, sizes,
                                                        blocking.substring_mask)), "substring")
        done, rest = _settled(v, s, steps, "substring", holds)
        return reduce(DataFrame.unionByName, [*done, _best(_score_full(substring_pairs(rest, s), rest, s), "substring")])
    pairs = substring_pairs(keys, suppliers)
    p = pairs.join(suppliers.select("supplier_norm", "supplier_pos", "supplier"), "supplier_norm")
    p = p.select("*", scorer(F.col("vendor_norm"), F.col("supplier_norm")).alias("score"))
    return _best(p, "substring")


def match_decisions(blocks: DataFrame, suppliers: DataFrame, tiers=("exact", "fuzzy"),
                    min_score: int | None = None, scorer: Scorer = similarity,
                    min_shared_run: int = 3) -> DataFrame:
    """Tier cascade over the distinct vendor norms of ``blocks``."""
    unknown = set(tiers) - set(TIERS)
    if unknown:
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    if min_score is not None and not (0 <= min_score <= 100):
        raise ValueError(f"min_score must be within 0..100, got {min_score}")
    keys = vendor_keys(blocks)
    decided = []
    todo = keys
    for tier in [t for t in TIERS if t in tiers]:
        if tier == "exact":
            d = match_exact(todo, suppliers)
        elif tier == "substring":
            d = match_substring(todo, suppliers, scorer)
        else:
            d = match_fuzzy(todo, suppliers, min_score, scorer, min_shared_run)
        # staged: the report and the tiers that follow read them, some in several branches
        decided.append(materialize(d.select(DECISION_COLS), f"matched-{tier}"))
        todo = materialize(residual(todo, decided[-1]), f"left-by-{tier}")
    if not decided:
        return keys.select("vendor_norm", *[F.lit(None).alias(c) for c in DECISION_COLS[1:]]).limit(0)
    return reduce(DataFrame.unionByName, decided)


def match_report(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """One report row per (sheet, vendor); vendors without a decision are
    ``no_match`` with a null supplier, score 0 and their amount kept."""
    r = blocks.join(decisions, "vendor_norm", "left")
    matched = F.col("match_type").isNotNull()
    return r.select(
        "sheet_id", "vendor_norm", "first_pos", "vendor",
        F.when(matched, F.col("supplier")).alias("supplier"),
        F.coalesce(F.col("match_type"), F.lit("no_match")).alias("match_type"),
        F.coalesce(F.col("score"), F.lit(0)).alias("score"),
        F.col("amount").alias("amount_added"),
        F.when(matched, F.col("supplier_pos")).alias("supplier_pos"),
    )
