"""The search by bounds: bounds hold, nothing is lost whatever the blocks, pairs are pruned."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.scoring import bounded as with_bound
from ledgermatch.functions.scoring import edit_ratio, similarity, similarity_bound, token_sort
from ledgermatch.functions.text import shares_ngram
from ledgermatch.operators import bounded as BD
from ledgermatch.operators import matching as M
from ledgermatch.session import materialize


def names(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", weights=range(1, 9), k=rng.randint(1, 9))) for _ in range(40)]
    out = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)}
    return sorted(out | {"a", "aaa", "aaaa aaaa", "abc " * 60 + "abc", "b a", "ab"})


@pytest.fixture(scope="module")
def sides(spark):
    v = spark.createDataFrame([(x,) for x in names(150, 1)], "vendor_norm string")
    s = spark.createDataFrame([(x, i, x.upper(), 1) for i, x in enumerate(names(100, 2))],
                              "supplier_norm string, supplier_pos int, supplier string, n_rows int")
    return materialize(v, "test-vendors"), materialize(s, "test-suppliers")


def brute(sides, scorer, min_score=None):
    v, s = sides
    p = (v.join(s, how="cross").where(shares_ngram("vendor_norm", "supplier_norm"))
         .select("vendor_norm", "supplier_norm", "supplier_pos", scorer(F.col("vendor_norm"), F.col("supplier_norm")).alias("score")))
    best = {}
    for r in p.collect():
        if min_score is None or r.score >= min_score:
            k = (r.score, -r.supplier_pos, r.supplier_norm)
            best[r.vendor_norm] = max(best.get(r.vendor_norm, k), k)
    return {v: (k[2], k[0]) for v, k in best.items()}


def found(df):
    return {r.vendor_norm: (r.supplier_norm, r.score) for r in df.collect()}


def test_shared_grams_are_counted():
    a, b = names(60, 3), names(50, 4)
    for q in (1, 2, 3):
        got = BD.shared_grams(a, b, q)
        for i in range(0, len(a), 7):
            for j in range(0, len(b), 5):
                x, y = ([n[k:k + q] for k in range(len(n) - q + 1)] for n in (a[i], b[j]))
                assert got[i, j] == sum(min(x.count(g), y.count(g)) for g in set(x))


def test_bounds_are_never_below_the_score(spark, sides):
    v, s = sides
    a, b = ([r[0] for r in d.collect()] for d in (v, s.select("supplier_norm")))
    for scorer in (similarity, edit_ratio):
        most = BD.tile_bounds(a, b, scorer.bound, 3)
        pairs = v.join(s, how="cross").select("vendor_norm", "supplier_norm", scorer(F.col("vendor_norm"), F.col("supplier_norm")).alias("score"),
                                              shares_ngram("vendor_norm", "supplier_norm").alias("run"))
        at = ({x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)})
        for r in pairs.collect():
            bound = most[at[0][r.vendor_norm], at[1][r.supplier_norm]]
            assert bound >= r.score if r.run else bound == -1


@pytest.mark.parametrize("blocks", [(512, 4096), (25, 15)])
def test_best_partner_by_bounds(sides, monkeypatch, blocks):
    monkeypatch.setattr(BD, "VENDORS", blocks[0])
    monkeypatch.setattr(BD, "SUPPLIERS", blocks[1])
    want = brute(sides, similarity)
    assert found(M.match_fuzzy(*sides)) == want
    assert found(M.match_fuzzy(*sides, steps=(90, 75))) == want
    assert found(M.match_fuzzy(*sides, min_score=80)) == brute(sides, similarity, 80)
    assert found(M.match_fuzzy(*sides, min_score=30)) == brute(sides, similarity, 30)


def test_many_names_take_the_segment_join(sides, monkeypatch):
    monkeypatch.setattr(M, "PAIRS_BY_BOUNDS", 0)
    assert found(M.match_fuzzy(*sides)) == brute(sides, similarity)
    assert found(M.match_fuzzy(*sides, min_score=80)) == brute(sides, similarity, 80)


def test_custom_scorer_with_a_bound_prunes(spark, sides):
    from pyspark.sql import Column

    def halved(a, b) -> Column:
        return F.floor(similarity(a, b) / 2).cast("int")

    scorer = with_bound(halved, lambda n, m, shared: np.floor(similarity_bound(n, m, shared) / 2))
    for min_score in (None, 35):
        assert found(M.match_fuzzy(*sides, min_score=min_score, scorer=scorer)) == brute(sides, halved, min_score)
    assert found(M.match_fuzzy(*sides, scorer=halved)) == brute(sides, halved)  # without a bound
    v = sides[0].select("vendor_norm", token_sort("vendor_norm").alias("vendor_sorted"))
    s = sides[1].select("supplier_norm", token_sort("supplier_norm").alias("supplier_sorted"), "supplier_pos", "supplier")
    pairs = BD.pairs_to_score(v, s, similarity.bound, 3, None, lambda p: M._score_full(p, v, s))
    assert pairs.count() < 0.5 * v.count() * s.count()


def test_nothing_to_match(spark, sides):
    v, s = sides
    assert found(M.match_fuzzy(v.limit(0), s)) == {} == found(M.match_fuzzy(v, s.limit(0)))
    assert found(M.match_fuzzy(v.limit(0), s, min_score=50)) == {}
