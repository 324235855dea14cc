"""Keyword tables, master round trips, sparse sheets, and the substring tier both ways."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgermatch.functions import screening as SC
from ledgermatch.functions.scoring import similarity
from ledgermatch.functions.text import runs_of, smart_substring_match
from ledgermatch.operators import keyword_index
from ledgermatch.operators import matching as M
from ledgermatch.operators import screening
from ledgermatch.operators import sheet as S
from ledgermatch.operators.screening import flag_by_table
from ledgermatch.session import materialize
from ledgermatch.sources import sheets as IO


@pytest.mark.parametrize("short", [4096, 0])
def test_keyword_table_flags_as_the_list_does(spark, monkeypatch, short):
    monkeypatch.setattr(screening, "SHORT_INDEX", short)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdeé\U0001f600 .", k=n))
    words = [word(rng.randint(1, 9)) for _ in range(600)] + ["Upper", "a", "", "ab", "aab", "aab", "x" * 40, "\U0001f600\U0001f600a"]
    texts = [word(rng.randint(0, 200)) for _ in range(150)] + [None, "", "a", "AB", "x" * 20000, word(20000)] + ["aab" * 50] * 30
    t = spark.createDataFrame([(i % 100, x, "extra") for i, x in enumerate(texts)], "id int, text string, flagged_by string").repartition(4)
    k = spark.createDataFrame([(i * 3, w) for i, w in enumerate(words)] + [(1, None)], "place long, keyword string").repartition(3)
    want = sorted((r.id, r.text, tuple(r.f or ())) for r in t.select("*", SC.flag_keywords("text", words).alias("f")).collect()
                  if r.text is not None)
    for cell, size in ((None, 0), (4, 0), (None, screening.INDEX_BYTES)):
        got = flag_by_table(t, k, pairs_per_cell=cell, index_bytes=size).collect()
        assert len(got) == len(texts) and [list(r.flagged) for r in got if r.text is None] == [[]]
        assert sorted((r.id, r.text, tuple(r.flagged)) for r in got if r.text is not None) == want
    for size in (0, screening.INDEX_BYTES):
        assert flag_by_table(t, k.limit(0), index_bytes=size).where("size(flagged) <> 0").isEmpty()
        assert flag_by_table(t.limit(0), k, index_bytes=size).isEmpty()


@pytest.mark.parametrize("positions, compared", [(1 << 20, 1 << 21), (7, 5)])
def test_keyword_index_finds_what_a_search_finds(monkeypatch, positions, compared):
    """Keywords of every length, at text edges, repeated, with zero bytes; a hundred thousand of them."""
    monkeypatch.setattr(keyword_index, "POSITIONS", positions)
    monkeypatch.setattr(keyword_index, "COMPARED", compared)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("ab\0é\U0001f600", k=n))
    keys = [word(rng.randint(0, 30)) for _ in range(300)] + ["", "a", "a", "ab" * 40, "\0" * 9]
    texts = [word(rng.randint(0, 60)) for _ in range(60)] + [None, "", "ab" * 40, "b" + "ab" * 40, *keys[:40]]
    index = keyword_index.KeywordIndex(keys)
    for some in (pa.array(texts), pa.array(texts)[5:40], pa.array([], pa.string()), pa.array([None, None], pa.string())):
        assert index.find(some).to_pylist() == [[] if t is None else [k for k in keys if k in t] for t in some.to_pylist()]
    assert keyword_index.KeywordIndex([]).find(pa.array(["a", None])).to_pylist() == [[], []]
    many = [f"key {i}" for i in range(100_000)]
    assert keyword_index.KeywordIndex(many).find(pa.array(["no", "a key 99999."])).to_pylist() == [
        [], ["key 9", "key 99", "key 999", "key 9999", "key 99999"]]


def test_runs_of_a_text(spark):
    texts = ["", "a", "ab", "abcabc", "ééé", "x" * 50000]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", runs_of("t", [1, 3]).alias("r"))
    for r in d.collect():
        assert set(r.r) == {r.t[i:i + n] for n in (1, 3) for i in range(len(r.t) - n + 1)} and len(r.r) == len(set(r.r))


MASTER = "row_pos bigint, `Odd, \"head\"` string, supplier string, invoice_total double, default_payment_method string, n int, Region string"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_master_round_trip(spark, tmp_path, fmt):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 'q"', "two\nlines", " s "]), f"Firm, {i}", rng.choice([None, 0.1, -1e30, 12345.67]), "ACH", i * 7, "x") for i in range(1, 300)]
    m = spark.createDataFrame(rows, MASTER).repartition(5)
    for name in (None, "My sheet"):
        IO.write_master(m, str(tmp_path), name, fmt)
        back = IO.read_master(spark, str(tmp_path), name)
        assert back.columns == m.columns and back.dtypes == m.dtypes
        assert [tuple(r) for r in back.orderBy("row_pos").collect()] == rows
    IO.write_master(m.limit(0), str(tmp_path), "Empty", fmt)
    assert IO.read_master(spark, str(tmp_path), "Empty").dtypes == m.dtypes and IO.read_master(spark, str(tmp_path), "Empty").isEmpty()


def test_sparse_positions_carry_in_two_levels(spark, monkeypatch):
    rng = random.Random(8)
    rows, dense = [], []
    for sheet in (1, None):
        at = -3 * 10**12
        for k in range(400):
            at += rng.choice([1, 10**7, 10**10])
            row = (rng.choice([None, None, None, "Acme", "Beta"]), rng.choice([None, "0", "5.00", "7"]))
            rows.append((sheet, at, *row))
            dense.append((sheet, k, *row))
    schema = "sheet_id long, row_pos long, vendor string, invoice_amount string"
    plain = S.mark_rows(spark.createDataFrame(dense, schema)).drop("row_pos").collect()
    positions = {}
    for s, at, *_ in rows:
        positions.setdefault(s, []).append(at)
    want = sorted(map(repr, plain))
    sparse = spark.createDataFrame(rows, schema).repartition(4)
    assert sorted(repr(r) for r in S.mark_rows(sparse).drop("row_pos").collect()) == want
    monkeypatch.setattr(S, "BLOCKS_IN_A_WINDOW", 1 << 62)
    assert sorted(repr(r) for r in S.mark_rows(sparse).drop("row_pos").collect()) == want
    assert S.mark_rows(sparse.limit(0)).isEmpty()


def test_substring_best_by_bounds_and_by_words(spark, monkeypatch):
    rng = random.Random(6)
    words = ["acme", "foods", "company", "north", "trade", "union", "of", "ltd", "incorporated", "steel"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    v = materialize(spark.createDataFrame([(x,) for x in {name() for _ in range(80)}], "vendor_norm string"), "test-v")
    s = materialize(spark.createDataFrame([(x, i, x, 1) for i, x in enumerate({name() for _ in range(60)})],
                                          "supplier_norm string, supplier_pos int, supplier string, n_rows int"), "test-s")
    pairs = v.join(s, how="cross").where(smart_substring_match("vendor_norm", "supplier_norm")).select(
        "vendor_norm", F.struct(similarity("vendor_norm", "supplier_norm").alias("score"), (-F.col("supplier_pos")).alias("p"), "supplier_norm").alias("b"))
    want = {r.vendor_norm: (r.b.supplier_norm, r.b.score) for r in pairs.groupBy("vendor_norm").agg(F.max("b").alias("b")).collect()}
    for limit in (M.PAIRS_BY_BOUNDS, 0):
        monkeypatch.setattr(M, "PAIRS_BY_BOUNDS", limit)
        assert {r.vendor_norm: (r.supplier_norm, r.score) for r in M.match_substring(v, s).collect()} == want
