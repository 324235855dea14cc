"""Similarity scores on normalised names (declared scorer, deviation V5).

``edit_ratio(a, b) = round(100 * (1 - levenshtein(a, b) / max(len a, len b)))`` with
JavaScript ``Math.round`` (half up), computed in integer arithmetic so Spark and
DuckDB agree bit for bit.  ``token_sort_ratio`` is the same ratio on the names with
their words sorted.  The default scorer is the greater of the two.

A scorer may declare ``scorer.bound(n, m, shared)``: the highest score that names of lengths
``n`` and ``m`` (numpy arrays, as the result) can have.  ``shared(q)`` is the number of
q-gram occurrences they share (their ends marked, so that a name of n characters has
n + q - 1), ``shared(q, words_sorted=True)`` the same with the words of both names sorted.  The search for best partners then scores only pairs whose bound
reaches the vendor's best; a scorer without a bound is given every pair.  ``bounded`` attaches a bound.

``max_edits(L, c)`` is the largest edit distance that still scores ``>= c`` for a
pair whose longer side has ``L`` characters:  ``200 d <= L (201 - 2c)``.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.text import _col

Scorer = Callable[[Column, Column], Column]


def ratio_from_distance(d, longest) -> Column:
    d, L = _col(d), _col(longest)
    return F.when(L == 0, F.lit(100)).otherwise(
        ((F.lit(200) * (L - d) + L) / (F.lit(2) * L)).cast("long")).cast("int")


def edit_ratio(a, b) -> Column:
    a, b = _col(a), _col(b)
    return ratio_from_distance(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def token_sort(norm) -> Column:
    return F.array_join(F.array_sort(F.split(_col(norm), " ")), " ")


def token_sort_ratio(a, b) -> Column:
    return edit_ratio(token_sort(a), token_sort(b))


def similarity(a, b) -> Column:
    """Default scorer: greatest of the plain and the token-sorted edit ratio (0..100)."""
    return F.greatest(edit_ratio(a, b), token_sort_ratio(a, b))


def similarity_bound(n, m, shared):
    """An edit changes one character and at most two 2-grams of either name; sorting the
    words keeps the characters."""
    longest = np.maximum(n, m)
    pairs = np.maximum(shared(2), shared(2, words_sorted=True))
    edits = np.maximum(longest - shared(1), np.ceil((longest + 1 - pairs) / 2))
    return np.floor((200 * (longest - edits) + longest) / (2 * longest))


similarity.bound = similarity_bound


def edit_ratio_bound(n, m, shared):
    longest = np.maximum(n, m)
    edits = np.maximum(longest - shared(1), np.ceil((longest + 1 - shared(2)) / 2))
    return np.floor((200 * (longest - edits) + longest) / (2 * longest))


edit_ratio.bound = edit_ratio_bound


def bounded(scorer: Scorer, bound) -> Scorer:
    """``scorer`` with a declared bound; the bound must never be below the score."""
    def score(a, b) -> Column:
        return scorer(a, b)

    score.bound = bound
    return score


def max_edits(longest, min_score: int) -> Column:
    """Largest edit distance d with ratio >= min_score for longer length ``longest``."""
    return ((_col(longest) * F.lit(201 - 2 * min_score)) / F.lit(200)).cast("long").cast("int")
