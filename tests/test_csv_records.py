"""CSV files cut into splits anywhere, headers of all kinds, and reading single sheets."""

import csv
import io
import random

import pytest

from ledgermatch.sources import sheets as IO
from ledgermatch.sources.records import read_records


@pytest.fixture(params=[40, 1 << 20])
def cut(spark, request):
    """Splits of 40 bytes (through records, cells and line ends), or none."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))


def test_records_of_any_splits(spark, tmp_path, cut):
    rng = random.Random(cut)
    want = {}
    for f in range(4):
        rows = [["Vendor", "Invoice Amount", "Note\nof two lines"]]
        for i in range(rng.choice([0, 1, 60])):
            rows.append([rng.choice(["Acme", "Bé, \"ta\"", "line\nfeed\n\nin cell", "\n", '"', "x" * 200, " s "]), str(i), rng.choice(["", "n", "a\r\nb"])])
        text = io.StringIO()
        csv.writer(text, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        body = rng.choice(["", "\n\r\n", "﻿"]) + text.getvalue() + rng.choice(["", "\n\n"])
        write(tmp_path / f"sheet_id={f}" / "part.csv", body if f % 2 else body.rstrip("\n") if rows[-1][-1] else body)
        want[str(f)] = [tuple(x or None for x in r) for r in rows[1:]]
    got = {k: [] for k in want}
    df = IO.read_sheet_csv(spark, str(tmp_path))
    if cut == 40:
        assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).rdd.getNumPartitions() > 20
    for r in df.orderBy("sheet_id", "row_pos").collect():
        got[r.sheet_id].append((r.vendor, r.invoice_amount, r["Note\nof two lines"]))
        assert r.row_pos == len(got[r.sheet_id])
    assert got == want


def test_headers_of_all_kinds(spark, tmp_path):
    write(tmp_path / "a.csv", '"Vendor\nName",Vendor,Invoice Amount\nx,Acme,1\n')
    write(tmp_path / "b.csv", "\n\r\nInvoice Amount,Vendor,,_split,_file,sheet_id\r\n2,Beta,e,s,f,q\r\n")
    write(tmp_path / "c.csv", "Vendor,Invoice Amount\nshort\nlong,3,extra\n")
    write(tmp_path / "d.csv", "\n\n")
    got = {r.row_pos if "c.csv" in r.sheet_id else r.sheet_id[-5]: r for r in IO.read_sheet_csv(spark, str(tmp_path)).collect()}
    assert (got["a"]["Vendor\nName"], got["a"].vendor, got["a"].invoice_amount) == ("x", "Acme", "1")
    b = got["b"]
    assert (b.vendor, b.invoice_amount, b["column 3"], b["_split"], b["_file"], b.sheet_id_cell) == ("Beta", "2", "e", "s", "f", "q")
    assert [(got[k].vendor, got[k].invoice_amount) for k in (1, 2)] == [("short", None), ("long", "3")] and len(got) == 4
    write(tmp_path / "e.csv", "Vendor,Vendor\n1,2\n")
    with pytest.raises(ValueError, match="repeated headers: Vendor .*e.csv"):
        IO.read_sheet_csv(spark, str(tmp_path))


def test_unclosed_quotes_are_told(spark, tmp_path):
    write(tmp_path / "a.csv", 'Vendor,Invoice Amount\n"Acme,1\nBeta,2\n')
    with pytest.raises(ValueError, match="not closed in: .*a.csv"):
        IO.read_sheet_csv(spark, str(tmp_path))
    assert IO.read_sheet_csv(spark, str(tmp_path), multiline=False).count() == 2
    (tmp_path / "empty").mkdir()
    write(tmp_path / "empty" / "none.csv", "")
    with pytest.raises(ValueError, match="no sheets"):
        IO.read_sheet_csv(spark, str(tmp_path / "empty"))


def test_one_sheet_opens_its_own_files_only(spark, tmp_path):
    write(tmp_path / "sheet_id=north" / "p0.csv", "Vendor,Invoice Amount\nAcme,1\n")
    write(tmp_path / "sheet_id=north" / "p1.csv", "Invoice Amount,Vendor\n2,Beta\n")
    bad = tmp_path / "sheet_id=south" / "p0.csv.gz"  # would raise when opened
    bad.parent.mkdir()
    bad.write_bytes(b"\x1f\x8bno gzip stream")
    listed = IO.sheet_catalogue(spark, str(tmp_path)).collect()
    assert sorted((r.sheet_id, r.size) for r in listed) == [("north", 29), ("north", 29), ("south", 16)]
    for name in (None, "north"):
        got = IO.read_sheet(spark, str(tmp_path), name).orderBy("row_pos").collect()
        assert [(r.sheet_id, r.row_pos, r.vendor, r.invoice_amount) for r in got] == [("north", 1, "Acme", "1"), ("north", 2, "Beta", "2")]
    with pytest.raises(ValueError, match='"east" not found. Available sheets: north, south'):
        IO.read_sheet(spark, str(tmp_path), "east")
    with pytest.raises(Exception, match="(?i)gzip|zip|compress|header"):
        IO.read_sheet(spark, str(tmp_path), "south").collect()


def test_plain_splits_are_not_shuffled_line_by_line(spark, tmp_path):
    write(tmp_path / "a.csv", "Vendor,Invoice Amount\n" + "Acme,1\n" * 1000)
    records, files = read_records(spark, str(tmp_path))
    assert [(r.records, r["head"]) for r in files.collect()] == [(1001, "Vendor,Invoice Amount")]
    plan = records.where("rec > 1")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the ordered lines of mixed splits are staged, plain ones only scanned
    assert records.count() == 1001
