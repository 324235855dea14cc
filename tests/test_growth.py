"""What must not grow faster than the input: sorts and shuffles of rows, lines and pairs, tasks of tiles."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.text import normalize_name, smart_substring_match
from ledgermatch.operators import blocking, bounded as BD, matching as M, sheet as S
from ledgermatch.session import materialize
from ledgermatch.sources import fixtures as X
from ledgermatch.sources import records as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(n, seed):
    rng = random.Random(seed)
    words = ["acme", "foods", "inc", "blue", "ring", "peru", "of", "large plate", "co", "quality", "vendor"]
    return sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)} | {"a", "acme acme", "acmefoods one"})


@pytest.fixture(scope="module")
def sides(spark):
    v = spark.createDataFrame([(x,) for x in names(120, 1)], "vendor_norm string")
    s = spark.createDataFrame([(x, i, x.upper(), 1) for i, x in enumerate(names(90, 2))],
                              "supplier_norm string, supplier_pos int, supplier string, n_rows int")
    return materialize(v, "test-vendors"), materialize(s, "test-suppliers")


def test_rows_of_blocks_are_hashed_before_texts_are_picked(spark):
    rows = [(s, i, v, a) for s in (None, 1) for i, (v, a) in enumerate(
        [("Acme", "1"), ("ACME ", "2"), (None, "3"), ("Beta", "5"), ("acme", "7"), (" ", "(7)"), ("Beta", None)])]
    sheet = spark.createDataFrame(rows, "sheet_id bigint, row_pos bigint, vendor string, invoice_amount string")
    sheet = materialize(sheet, "test-sheet")
    for block in (1, 3, 1 << 20):
        blocks = S.vendor_blocks(S.mark_rows(sheet, block))
        got = {(r.sheet_id, r.vendor_norm): (r.vendor, r.first_pos, r.last_pos, r.amount, r.detail_total) for r in blocks.collect()}
        for k in (None, 1):
            assert got[k, "acme"] == ("acme", 0, 4, -7.0, 10.0) and got[k, "beta"] == ("Beta", 3, 6, 0.0, 5.0)
        assert len(got) == 4
    first = [x for x in plan(blocks).splitlines() if "Aggregate(" in x and "filled_vendor" in x]
    assert first and all("HashAggregate" in x for x in first)


def test_tiles_are_tasks_of_their_own(spark, sides, monkeypatch):
    monkeypatch.setattr(BD, "VENDORS", 8)
    monkeypatch.setattr(BD, "SUPPLIERS", 16)
    v, s = sides
    pairs = BD.masked_pairs(v, s, blocking.substring_mask)
    tiles = -(-v.count() // 8) * -(-s.count() // 16)
    assert tiles > spark.sparkContext.defaultParallelism and f", {tiles})" in plan(pairs) and "REPARTITION_BY_NUM" in plan(pairs)


def test_substring_pairs_without_a_shuffle_of_pairs(spark, sides, monkeypatch):
    v, s = sides
    want = sorted(map(tuple, v.join(s, how="cross").where(smart_substring_match("vendor_norm", "supplier_norm"))
                      .select("vendor_norm", "supplier_norm").collect()))
    pairs = M.substring_pairs(v, s)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 100
    assert plan(pairs).index("FlatMapCoGroupsInArrow") < plan(pairs).index("Exchange")
    monkeypatch.setattr(M, "PAIRS_BY_BOUNDS", 0)
    assert sorted(map(tuple, M.substring_pairs(v, s).collect())) == want


def test_lines_are_not_shuffled(spark, tmp_path, monkeypatch):
    text = "Vendor,Invoice Amount\n" + "".join(f'"a\n""{i}"",\n",{i}\n\n' for i in range(50))
    (tmp_path / "x.csv").write_text(text)
    found = []
    for most in (R.SPLITS_TO_TASKS, 0):
        monkeypatch.setattr(R, "SPLITS_TO_TASKS", most)
        records, files = R.read_records(spark, str(tmp_path))
        found.append(sorted((r.rec, r.text) for r in records.collect()))
        if most:
            assert "Exchange hashpartitioning" not in plan(records) and "Window" not in plan(records)
    assert found[0] == found[1] and len(found[0]) == 51 and found[0][3] == (4, 'a\n""2"",\n",2'.join(['"', ""]))
    assert files.first()["head"] == "Vendor,Invoice Amount"


def test_staged_sheet_is_the_sheet_and_shuffles_lineitem_once(spark):
    rng = random.Random(5)
    lines = [(rng.choice([None, *range(30)]), rng.choice([None, 3, 7, 11, 13, 14, 22, 26]), rng.randint(1, 7), rng.randint(0, 9),
              float(rng.randint(1, 9)), rng.choice([None, 10.5, 20.25, 99999.0]), rng.randint(0, 5)) for _ in range(400)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, "
                          "l_extendedprice double, l_shipdate int").createOrReplaceTempView("lineitem")
    named = [(k, f"Vendor {k}") for k in (3, 7, 11, 13, 13, 14, 22, 26)]  # a key may repeat
    spark.createDataFrame(named, "k bigint, vendor string").createOrReplaceTempView("vendor_names")
    cols = ["sheet_id", "row_pos", "vendor", "invoice_amount"]
    key = lambda r: tuple(str(x) for x in r)
    staged = X._staged_sheet(spark)
    assert sorted(staged.select(cols).collect(), key=key) == sorted(spark.sql(X.VENDOR_SHEET_SQL).select(cols).collect(), key=key)
    assert plan(staged).count("l_linenumber") and plan(staged).count("Window ") <= 2
