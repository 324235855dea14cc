"""Sheet scan (G3), exact-tier update (G4), decisions (G6), screening (G7), blocking
losslessness and partition invariance."""

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.scoring import similarity, token_sort
from ledgermatch.functions.text import shares_ngram, smart_substring_match
from ledgermatch.operators import blocking as B
from ledgermatch.operators import matching as M
from ledgermatch.operators import sheet as S
from ledgermatch.operators.ordering import first_rows_per_sheet, with_row_index
from ledgermatch.plans.decisions import apply_decisions
from ledgermatch.plans.reconcile import reconcile
from ledgermatch.plans.screening import screen_text
from ledgermatch.sources import sheets as IO

G3 = [(0, None, "99"), (1, "Acme Foods", "10"), (2, "acme-foods", "20"), (3, None, "30"), (4, "Beta", None),
      (5, "Beta", "5"), (6, None, "0"), (7, "Gamma", "1"), (8, None, "7"), (9, None, "8"), (10, "Delta", "4"),
      (11, None, "4"), (12, " ", None), (13, "Eps", "2"), (14, None, "2"), (15, "Gamma", "3"),
      (16, None, "(3)"), (17, "Zeta", "6")]
G3_EXPECTED = [("acme foods", 1, "acme-foods", 30.0), ("beta", 4, "Beta", 0.0), ("gamma", 7, "Gamma", -3.0),
               ("delta", 10, "Delta", 0.0), ("eps", 13, "Eps", 2.0), ("zeta", 17, "Zeta", 0.0)]
G4_MASTER = [(0, "ACME Foods", "ACH", None), (1, "acme foods", "ACH", "100"), (2, "Gamma", "ACH", "N/A"),
             (3, "Beta", "ACH", None), (4, "Eps", "ACH", "(5)"), (5, "Other", "ACH", "$7.50")]
MASTER_SCHEMA = "row_pos long, supplier string, default_payment_method string, invoice_total string"
SHEET_SCHEMA = "sheet_id long, row_pos long, vendor string, invoice_amount string"


@pytest.fixture(scope="module")
def g3(spark):
    return spark.createDataFrame([(1, p, v, a) for p, v, a in G3], SHEET_SCHEMA)


@pytest.fixture(scope="module")
def g4_master(spark):
    return spark.createDataFrame(G4_MASTER, MASTER_SCHEMA)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1 << 20])
def test_vendor_blocks_g3_any_block_size(g3, block):
    out = S.vendor_blocks(S.mark_rows(g3, block)).orderBy("first_pos").collect()
    assert [(r.vendor_norm, r.first_pos, r.vendor, r.amount) for r in out] == G3_EXPECTED


def test_partition_invariance(g3):
    a = sorted(map(tuple, S.vendor_blocks(S.mark_rows(g3, 4)).collect()))
    b = sorted(map(tuple, S.vendor_blocks(S.mark_rows(g3.repartition(7, "row_pos"), 4)).collect()))
    assert a == b


def test_exact_update_g4(g3, g4_master):
    res = reconcile(g4_master, g3, tiers=("exact",))
    totals = {r.row_pos: r.invoice_total for r in res.updated_master.collect()}
    assert totals == {0: 30.0, 1: 100.0, 2: -3.0, 3: None, 4: -3.0, 5: 7.5}
    rep = {r.vendor: (r.supplier, r.match_type, r.score) for r in res.match_report.collect()}
    assert rep["acme-foods"] == ("ACME Foods", "exact", 100)
    assert rep["Delta"] == (None, "no_match", 0) and rep["Zeta"] == (None, "no_match", 0)
    assert res.updated_master.columns == ["row_pos", "supplier", "default_payment_method", "invoice_total"]


def test_missing_columns_raise(spark, g3):
    bad = spark.createDataFrame([(0, "x")], "row_pos long, supplier string")
    with pytest.raises(ValueError, match="Universal Database missing columns: Default payment method, Invoice Total"):
        reconcile(bad, g3)


def test_decisions_g6(spark, g4_master):
    resp = [(1, '[{"vendor":"a","supplier":"Gamma","score":88,"amount":1.5},'
                '{"vendor":"a","supplier":"Gamma","match_type":"exact","score":100,"amount":2},'
                '{"vendor":"b","supplier":"gamma"},{"vendor":"c","supplier":null,"amount":4},'
                '{"vendor":"d","supplier":"Eps","match_type":"no_match","score":40,"amount":3},'
                '{"supplier":"Eps","amount":9}]'), (2, "not json")]
    out = apply_decisions(g4_master, spark.createDataFrame(resp, "request_id long, response string"))
    rows = sorted((r.idx, r.vendor, r.supplier, r.match_type, r.score, r.amount_added)
                  for r in out.match_report.collect())
    assert rows == [(0, "a", "Gamma", "fuzzy", 88.0, 1.5), (1, "a", "Gamma", "exact", 100.0, 2.0),
                    (2, "b", None, "no_match", 0.0, 0.0), (3, "c", None, "no_match", 0.0, 4.0),
                    (4, "d", None, "no_match", 0.0, 3.0)]
    totals = {r.row_pos: r.invoice_total for r in out.updated_master.collect()}
    assert totals[2] == 3.5 and totals[4] == -5.0 and totals[0] is None
    assert [r.request_id for r in out.quarantine.collect()] == [2]


def test_screening_g7(spark):
    texts = spark.createDataFrame([(1, "So BADly"), (2, ""), (3, None), (4, "fine")], "text_id long, text string")
    out = {r.text_id: r for r in screen_text(texts, keywords=["bad", "worse"]).collect()}
    assert out[1].verdict.is_offensive and out[1].verdict.flagged_words == ["bad"]
    assert out[1].verdict.severity == "medium" and out[1].warning.endswith("\nFlagged words: bad")
    assert out[2].verdict.message == "Content is valid" and out[3].verdict.message == "Content is valid"
    assert not out[4].verdict.is_offensive
    resp = spark.createDataFrame([(4, '{"isOffensive": true}'), (1, '{"isOffensive": true, "severity": "high"}')],
                                 "text_id long, response string")
    out = {r.text_id: r for r in screen_text(texts, keywords=["bad"], responses=resp).collect()}
    assert out[4].verdict.severity == "medium"
    assert "This is a serious violation. " in out[1].verdict.message


def _names(spark, sf):
    from ledgermatch.sources.fixtures import table
    u = table(spark, sf, "universal")
    v = table(spark, sf, "vendor_names")
    sup = M.supplier_index(u)
    keys = v.select(M.normalize_name("vendor").alias("vendor_norm")).where("vendor_norm != ''").distinct()
    return keys, sup


def test_threshold_blocking_is_lossless(spark):
    keys, sup = _names(spark, "/root/testdata/sf0.001")
    v = keys.select("vendor_norm", token_sort("vendor_norm").alias("vendor_sorted"))
    s = sup.select("supplier_norm", token_sort("supplier_norm").alias("supplier_sorted"))
    for c in (60, 75, 85, 95):
        blocked = set(map(tuple, B.threshold_candidates(v, s, c).distinct().collect()))
        brute = v.join(s, how="cross").where((similarity("vendor_norm", "supplier_norm") >= c)
                                             & shares_ngram("vendor_norm", "supplier_norm"))
        truth = set(map(tuple, brute.select("vendor_norm", "supplier_norm").collect()))
        assert truth <= blocked


def test_ngram_and_substring_blocking_are_lossless(spark):
    keys, sup = _names(spark, "/root/testdata/sf0.001")
    brute = keys.join(sup.select("supplier_norm"), how="cross")
    g = set(map(tuple, B.ngram_candidates(keys, sup).collect()))
    assert set(map(tuple, brute.where(shares_ngram("vendor_norm", "supplier_norm"))
                   .select("vendor_norm", "supplier_norm").collect())) == g
    s = set(map(tuple, M.substring_pairs(keys, sup).select("vendor_norm", "supplier_norm").collect()))
    assert set(map(tuple, brute.where(smart_substring_match("vendor_norm", "supplier_norm"))
                   .select("vendor_norm", "supplier_norm").collect())) == s


def test_fuzzy_parity_equals_brute_force(spark):
    keys, sup = _names(spark, "/root/testdata/sf0.001")
    got = {r.vendor_norm: (r.supplier_norm, r.score) for r in M.match_fuzzy(keys, sup).collect()}
    pairs = (keys.join(sup, how="cross").where(shares_ngram("vendor_norm", "supplier_norm"))
             .select("vendor_norm", "supplier_norm", "supplier_pos",
                     similarity("vendor_norm", "supplier_norm").alias("score")).collect())
    best = {}
    for r in pairs:
        k = (r.score, -r.supplier_pos)
        if r.vendor_norm not in best or k > best[r.vendor_norm][0]:
            best[r.vendor_norm] = (k, r.supplier_norm)
    assert got == {v: (s, k[0]) for v, (k, s) in best.items()}


def test_row_index_and_head(spark, g3):
    idx = with_row_index(g3, [F.col("row_pos").desc()], "i").collect()
    assert sorted((r.row_pos, r.i) for r in idx) == [(p, 18 - p) for p in range(18)]
    head = first_rows_per_sheet(g3, 5, rows_per_block=2).orderBy("row_pos").collect()
    assert [(r.row_pos, r.row_idx) for r in head] == [(p, p + 1) for p in range(5)]


def test_csv_round_trip(spark, g3):
    path = IO.scratch_path(spark, "test-sheets")
    IO.write_sheets_csv(g3.where(F.col("vendor").isNotNull() | F.col("invoice_amount").isNotNull()), path)
    back = IO.read_sheet_csv(spark, path).select(F.col("sheet_id").cast("long"), "row_pos", "vendor",
                                                 "invoice_amount")
    want = g3.where(F.col("vendor").isNotNull() | F.col("invoice_amount").isNotNull()).orderBy("row_pos").collect()
    got = back.orderBy("row_pos").collect()
    assert [(r.vendor, r.invoice_amount) for r in got] == [(r.vendor, r.invoice_amount) for r in want]
    assert [r.row_pos for r in got] == list(range(1, len(want) + 1))
    with pytest.raises(ValueError, match="not found"):
        IO.select_sheet(back, 99)


def test_custom_scorer_equals_brute_force(spark):
    """A caller-supplied scorer takes the 3-gram path; top-1 must equal brute force."""
    from ledgermatch.functions.scoring import edit_ratio
    keys, sup = _names(spark, "/root/testdata/sf0.001")
    for min_score in (None, 40):
        got = {r.vendor_norm: (r.supplier_norm, r.score)
               for r in M.match_fuzzy(keys, sup, min_score=min_score, scorer=edit_ratio).collect()}
        pairs = (keys.join(sup, how="cross").where(shares_ngram("vendor_norm", "supplier_norm"))
                 .select("vendor_norm", "supplier_norm", "supplier_pos",
                         edit_ratio("vendor_norm", "supplier_norm").alias("score")).collect())
        best = {}
        for r in pairs:
            if min_score is not None and r.score < min_score:
                continue
            k = (r.score, -r.supplier_pos)
            if r.vendor_norm not in best or k > best[r.vendor_norm][0]:
                best[r.vendor_norm] = (k, r.supplier_norm)
        assert got == {v: (s, k[0]) for v, (k, s) in best.items()}


def test_multiline_csv_cells(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Vendor,Invoice Amount\n"Acme\nFoods",10\n,"1,000.50"\nBeta,5\n')
    df = IO.read_sheet_csv(spark, path, multiline=True).orderBy("row_pos").collect()
    assert [(r.row_pos, r.vendor, r.invoice_amount) for r in df] == \
        [(1, "Acme\nFoods", "10"), (2, None, "1,000.50"), (3, "Beta", "5")]
