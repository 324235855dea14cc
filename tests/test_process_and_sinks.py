"""P7/P8 parameter handling and the S4 master writer."""

import pytest

from ledgermatch.plans.process import coerce_method, coerce_threshold, process
from ledgermatch.sources import sheets as IO
from ledgermatch.sources.fixtures import table

SF = "/root/testdata/sf0.001"


def test_parameter_coercion():
    assert coerce_threshold(None) == 85 and coerce_threshold("90") == 90.0 and coerce_threshold(0) == 0
    for bad in ("abc", -1, 101):
        with pytest.raises(ValueError):
            coerce_threshold(bad)
    assert coerce_method(" Decisions ") == "decisions" and coerce_method(None) == "fuzzy"
    with pytest.raises(ValueError):
        coerce_method("magic")


def test_process_paths_and_write_master(spark):
    master = table(spark, SF, "universal")
    fz = process(master, table(spark, SF, "vendor_sheet"))
    dc = process(master, method="decisions", responses=table(spark, SF, "match_responses"))
    assert fz.updated_master.count() == dc.updated_master.count() == master.count()
    path = IO.scratch_path(spark, "test-master")
    for fmt in ("parquet", "csv"):
        target = IO.write_master(dc.updated_master, f"{path}/{fmt}", fmt=fmt)
        assert target.endswith("/Universal Database")
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.format(fmt).load(target)
        assert back.count() == master.count()
        # CSV carries the sheet's own headers (as the reference's file does), parquet the canonical columns
        headers = ["Supplier", "Default payment method", "Invoice Total"]
        assert back.columns == (headers if fmt == "csv" else dc.updated_master.columns)
