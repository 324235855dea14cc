"""SURVEY §5 invariants on the sf0.001 fixture, and the hot-sheet case."""

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import parse_amount
from ledgermatch.operators import sheet as S
from ledgermatch.plans.reconcile import reconcile
from ledgermatch.sources.fixtures import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return table(spark, SF, "universal"), table(spark, SF, "vendor_sheet")


@pytest.mark.parametrize("min_score", [None, 85])
def test_report_and_master_invariants(inputs, min_score):
    master, sheets = inputs
    res = reconcile(master, sheets, tiers=("exact", "substring", "fuzzy"), min_score=min_score)
    rep = res.match_report
    # each (sheet, vendor) once
    assert rep.count() == rep.select("sheet_id", "vendor_norm").distinct().count()
    # exact rows score 100; no_match rows have no supplier and score 0
    assert rep.where("match_type = 'exact' and score <> 100").count() == 0
    assert rep.where("match_type = 'no_match' and (supplier is not null or score <> 0)").count() == 0
    if min_score is not None:
        assert rep.where(f"match_type in ('fuzzy') and score < {min_score}").count() == 0
    # master keeps its rows and pass-through columns
    upd = res.updated_master
    assert upd.count() == master.count()
    assert upd.select("row_pos", "supplier", "default_payment_method").exceptAll(
        master.select("row_pos", "supplier", "default_payment_method")).count() == 0
    # added amounts = change of totals
    before = master.select(F.sum(F.coalesce(parse_amount("invoice_total"), F.lit(0.0)).cast("decimal(38,10)")))
    after = upd.select(F.sum(F.coalesce("invoice_total", F.lit(0.0)).cast("decimal(38,10)")))
    added = rep.where("match_type <> 'no_match'").select(F.sum(F.col("amount_added").cast("decimal(38,10)")))
    assert abs(float(after.first()[0]) - float(before.first()[0]) - float(added.first()[0] or 0)) < 1e-6


def test_hot_sheet_blocks_match_single_block(inputs):
    """All rows in one sheet (a third or more of the data in one key): tiny blocks give
    exactly the result of one block."""
    _, sheets = inputs
    one = sheets.select(F.lit(0).cast("long").alias("sheet_id"),
                        (F.col("sheet_id") * 100000 + F.col("row_pos")).alias("row_pos"),
                        "vendor", "invoice_amount")
    a = sorted(map(tuple, S.vendor_blocks(S.mark_rows(one, 37)).collect()))
    b = sorted(map(tuple, S.vendor_blocks(S.mark_rows(one, 1 << 40)).collect()))
    assert a == b and len(a) > 0
