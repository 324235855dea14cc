"""Inputs that the generated fixtures do not hold: nothing is lost, cut or silently changed."""

import re

import pytest

from ledgermatch.functions import screening as SC
from ledgermatch.operators import decisions as D
from ledgermatch.operators.screening import parse_verdicts, screen_texts
from ledgermatch.operators.sheet import mark_rows
from ledgermatch.plans import process as PR
from ledgermatch.sources.sheets import select_sheet


def test_every_decision_element_ends_in_one_output(spark):
    ok = '{"vendor":"a","supplier":"s","score":%s,"amount":%s}'
    texts = ["[" + ok % ("90", "8") + "]", "[" + ok % ('"90"', '"12.50"') + "]", "[" + ok % ("1", '"abc"') + ',"x",null,[1]]',
             "[" + ok % ("1", "2") + "] thanks", "[] []", "{}", "not json", None, "[]", "```json\n[" + ok % ("null", '""') + "]\n```",
             "[" + ok % ("1", '"NaN"') + "]", "[" + ok % ("1", "true") + "]"]
    r = spark.createDataFrame(list(enumerate(texts)), "request_id int, response string")
    good = {(x.request_id, x.idx): (x.score, x.amount) for x in D.parse_decisions(r).collect()}
    assert good == {(0, 0): (90.0, 8.0), (1, 0): (90.0, 12.5), (9, 0): (0.0, 0.0)}
    bad = [(x.request_id, x.idx, x.reason) for x in D.quarantined_responses(r).collect()]
    assert sorted((a, b) for a, b, c in bad if c != D.NOT_AN_ARRAY) == [(2, 0), (2, 1), (2, 2), (2, 3), (10, 0), (11, 0)]
    assert sorted(a for a, _, c in bad if c == D.NOT_AN_ARRAY) == [3, 4, 5, 6, 7]


def test_verdicts_by_truth_and_one_per_id(spark):
    cases = {1: ('\n{"isOffensive": true}\n', True), 2: ('{"isOffensive": "true"}', True), 3: ('{"isOffensive": 1}', True),
             4: ('{"isOffensive": 0}', False), 5: ("[1]", False), 6: ("true", False), 7: ('{"isOffensive": ""}', False)}
    unusable = {8: '{"isOffensive": true} hope', 9: "null", 10: "nothing", 11: None}
    rows = [(k, v) for k, (v, _) in cases.items()] + list(unusable.items()) + [(7, '{"isOffensive": true}'), (7, "junk")]
    got = parse_verdicts(spark.createDataFrame(rows, "text_id int, response string")).collect()
    by_id = {r.text_id: r.parsed for r in got}
    assert len(got) == len(by_id) == 11
    assert {k: by_id[k].isOffensive for k in cases} == {**{k: v for k, (_, v) in cases.items()}, 7: True}
    assert all(by_id[k] is None for k in unusable)


def test_keyword_list_may_be_empty(spark):
    d = spark.createDataFrame([("damn",), ("",), (None,)], "text string")
    flagged = [r[0] for r in d.select(SC.flag_keywords("text", [])).collect()]
    assert all(not f for f in flagged)
    assert [r.warning for r in screen_texts(d, keywords=["amn"]).collect()][0] != SC.MSG_FALLBACK_CLEAN


def test_all_sheets_are_listed_and_the_first_is_the_default(spark):
    d = spark.range(60).selectExpr("id as sheet_id", "1 as row_pos", "'v' as vendor", "'1' as invoice_amount")
    with pytest.raises(ValueError) as e:
        select_sheet(d, 99)
    assert str(e.value).endswith("58, 59")
    assert [r.sheet_id for r in select_sheet(d).collect()] == [0]


def test_rows_without_sheet_id_stay(spark):
    d = spark.createDataFrame([(None, 1, "a", "1"), (None, 2, None, "5"), (1, 1, "b", "2")],
                              "sheet_id long, row_pos long, vendor string, invoice_amount string")
    got = {(r.sheet_id, r.row_pos): (r.filled_vendor, r.is_total) for r in mark_rows(d, 1).collect()}
    assert got == {(None, 1): ("a", False), (None, 2): (None, True), (1, 1): ("b", False)}


def test_fractional_threshold_is_not_cut(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(PR, "reconcile", lambda *a, min_score, **k: seen.update(m=min_score) or PR.ProcessResult(None, None) and type("R", (), {"updated_master": None, "match_report": None}))
    PR.process(None, sheets=object(), similarity_threshold=85.9, apply_threshold=True)
    assert seen["m"] == 86


def test_amounts_beyond_the_decimal_range_neither_fail_nor_vanish(spark):
    from ledgermatch.functions.render import display_number
    from ledgermatch.plans.reconcile import reconcile

    sheet = [("big", "1"), (None, "9" * 30), ("small", "1"), (None, "0.00000000001"), ("plain", "1"), (None, "0.1"), ("huge", "1"), (None, "9" * 400)]
    s = spark.createDataFrame([(1, i, v, a) for i, (v, a) in enumerate(sheet)], "sheet_id long, row_pos long, vendor string, invoice_amount string")
    m = spark.createDataFrame([(i, n, "ACH", None) for i, n in enumerate(["big", "small", "plain", "huge"])],
                              "row_pos long, supplier string, default_payment_method string, invoice_total string")
    got = {r.supplier: r.invoice_total for r in reconcile(m, s, tiers=("exact",)).updated_master.collect()}
    assert got == {"big": 1e30, "small": 1e-11, "plain": 0.1, "huge": float("inf")}
    shown = spark.createDataFrame([(12345.67,), (-5.0,), (0.0,), (1e20,), (1e30,), (1e-11,), (None,)], "a double")
    assert [r[0] for r in shown.select(display_number("a")).collect()] == ["12345.67", "-5", "0", "1" + "0" * 20, "1e+30", "1e-11", None]


def test_hot_keys_cut_into_cells_give_the_same_pairs(spark):
    from ledgermatch.operators.blocking import ngram_candidates, substring_candidates

    v = spark.range(40).selectExpr("concat('vendor ', id % 7, ' foods company') as vendor_norm").distinct()
    s = spark.range(60).selectExpr("concat('acme ', id, ' company') as supplier_norm")
    for pairs in (ngram_candidates, substring_candidates):
        whole = set(map(tuple, pairs(v, s).collect()))
        assert len(whole) == 7 * 60 and whole == set(map(tuple, pairs(v, s, pairs_per_cell=9).collect()))


def test_sheet_scan_shuffles_rows_once(spark):
    d = spark.range(1000).selectExpr("id % 3 as sheet_id", "id as row_pos", "cast(id as string) as vendor", "cast(id * 2 as string) as invoice_amount")
    plan = mark_rows(d)._jdf.queryExecution().explainString(
        d.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    # one exchange carries rows; the others carry the block summary and what comes from it
    assert sum("invoice_amount#" in cols for cols in inputs) == 1 and "CartesianProduct" not in plan


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    from ledgermatch.sources.sheets import read_sheet_csv

    for name, text in (("sheet_id=1", 'Vendor,Invoice Amount\nAlpha,"1\n2"\n'), ("sheet_id=01", "Invoice Amount,Vendor\n77,Beta\n\"8,5\",Ga\"\"mma\n")):
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "a.csv").write_text(text)
    got = sorted((r.sheet_id, r.row_pos, r.vendor, r.invoice_amount) for r in read_sheet_csv(spark, str(tmp_path / "s")).collect())
    assert got == [("01", 1, "Beta", "77"), ("01", 2, 'Ga""mma', "8,5"), ("1", 1, "Alpha", "1\n2")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("Vendor,Vendor\na,b\n")
    with pytest.raises(ValueError, match="repeated headers: Vendor"):
        read_sheet_csv(spark, str(tmp_path / "t"))


def test_master_csv_has_its_headers_and_order(spark, tmp_path):
    from ledgermatch.sources.sheets import write_master

    d = spark.range(50).selectExpr("50 - id as row_pos", "cast(50 - id as string) as supplier", "'ACH' as default_payment_method", "1.0D as invoice_total", "id as Note")
    target = write_master(d, str(tmp_path), fmt="csv")
    lines = [x for f in sorted((tmp_path / target.rsplit("/", 1)[1]).glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "Supplier,Default payment method,Invoice Total,Note"
    assert [int(x.split(",")[0]) for x in lines if not x.startswith("Supplier")] == list(range(1, 51))


def request_tables(spark):
    master = spark.createDataFrame([(i, f"Firm {i}", "cash", "1.00") for i in range(1, 251)],
                                   "row_pos bigint, supplier string, default_payment_method string, invoice_total string")
    sheet = [(s, i, f"vendor {i:03}", "5.00") for s in (1, None) for i in range(1, 301)]
    return master, spark.createDataFrame(sheet, "sheet_id bigint, row_pos bigint, vendor string, invoice_amount string")


def test_match_requests_carry_everything(spark):
    from ledgermatch.plans.requests import rebuild_request

    r = PR.prepare_requests(*request_tables(spark), similarity_threshold="72.5", batch_chars=1000)
    line = len('100. "vendor 100" (Amount: 0)') + 1
    batches = {(b.sheet_id, b.batch_no): b for b in r.batches.collect()}
    for s in (1, None):
        mine = [b for (k, _), b in sorted(batches.items(), key=lambda x: x[0][1]) if k == s]
        assert sum(b.n_vendors for b in mine) == 300 and [b.n_vendors for b in mine] == [len(b.text.split("\n")) - 1 for b in mine]
        assert all(b.n_vendors * (line - 2) <= 1000 + line and (b.n_suppliers, b.n_unique_vendors) == (250, 300) for b in mine)
        asked = [x for b in mine for x in b.text.split("\n")[1:]]
        assert asked == [f'{n}. "vendor {n:03}" (Amount: 0)' for n in range(1, 301)]
    assert all("at least 72.5 of 100" in b.text and f"the {b.n_vendors} vendors" in b.text for b in batches.values())
    # the two sheets hold the same: their chunks are stored once; nothing grows with the batches
    assert r.contexts.count() == 3 + 3 + 2 * 3 and r.chunks.count() == 3 + 3 + 3
    for s in (1, None):
        pieces = rebuild_request(r, s, 2).collect()
        whole = "\n".join(p.text for p in pieces)
        assert whole == "\n".join(
            [f'{i}. "Firm {i}"' for i in range(1, 251)]
            + ["Supplier,Default payment method,Invoice Total"] + [f"Firm {i},cash,1.00" for i in range(1, 251)]
            + ["Vendor,Invoice Amount"] + [f"vendor {i:03},5.00" for i in range(1, 301)] + [batches[s, 2].text])
    with pytest.raises(ValueError):
        PR.prepare_requests(*request_tables(spark), similarity_threshold=101)


def test_bounded_requests_and_heads_of_a_null_sheet(spark):
    from ledgermatch.operators.ordering import first_rows_per_sheet
    from ledgermatch.plans.requests import build_bounded_requests

    master, sheets = request_tables(spark)
    got = build_bounded_requests(master, sheets, 100, 3, rows_per_block=64).collect()
    assert sorted(((r.sheet_id or 0, r.batch_no) for r in got)) == [(s, b) for s in (0, 1) for b in range(6)]
    assert {(r.sheet_csv[:30], r.supplier_overflow) for r in got} == {("Vendor,Invoice Amount\nvendor 0", "... and 247 more suppliers")}
    heads = first_rows_per_sheet(sheets, 2, 1).collect()
    assert sorted((r.sheet_id or 0, r.row_pos, r.row_idx) for r in heads) == [(s, k, k) for s in (0, 1) for k in (1, 2)]


def test_running_totals_over_partitions(spark):
    from ledgermatch.operators.ordering import with_running_total
    from pyspark.sql import functions as F

    rows = [(g, i, i % 7 if i % 5 else None) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(6)
    for groups in (["g"], []):
        got = with_running_total(df, F.col("x"), ["i"] if groups else ["g", "i"], "t", groups).collect()
        total, last = 0, None
        for r in sorted(got, key=lambda r: (r.g, r.i)):
            total = 0 if groups and r.g != last else total
            assert r.t == total
            total, last = total + (r.x or 0), r.g
        assert len(got) == 400
