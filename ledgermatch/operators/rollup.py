"""Adding matched amounts to the supplier master.

``supplier_totals`` sums accepted amounts per master row as DECIMAL (order-independent);
``update_master`` keeps every master row and column, replacing ``invoice_total`` with
``parsed original (blank/unparseable -> 0) + added`` and restoring null where the
original cell was blank and the new total is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import grouped_sum, null_preserving_total, parse_amount


def supplier_totals(report: DataFrame) -> DataFrame:
    """A3: total accepted amount per master row (``supplier_pos``)."""
    accepted = report.where((F.col("match_type") != "no_match") & F.col("supplier_pos").isNotNull())
    return grouped_sum(accepted, ["supplier_pos"], F.coalesce(F.col("amount_added"), F.lit(0.0)), "added",
                       {"n_matches": (F.count(F.lit(1)), F.sum)})


def update_master(master: DataFrame, totals: DataFrame) -> DataFrame:
    """Master with updated ``invoice_total`` (DOUBLE), columns in original order."""
    t = totals.select(F.col("supplier_pos").alias("_pos"), F.col("added").alias("_added"))
    j = master.join(t, master.row_pos == t._pos, "left")
    start = F.coalesce(parse_amount(F.col("invoice_total")), F.lit(0.0))
    new_total = start + F.coalesce(F.col("_added"), F.lit(0.0))
    cols = [null_preserving_total(F.col("invoice_total"), new_total).alias("invoice_total")
            if c == "invoice_total" else F.col(c) for c in master.columns]
    return j.select(*cols)
