"""Match report views: ranking (O1/W6/F17), counts (A5), unmatched vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import grouped_sum
from ledgermatch.operators.ordering import with_row_index


def ranked_report(report: DataFrame) -> DataFrame:
    """Exact matches first, then score descending; ties keep first-appearance order
    (sheet, first position).  ``rank`` is the 1-based display number; blank display
    cells are empty strings."""
    keyed = report.select("*", F.when(F.col("match_type") == "exact", 0).otherwise(1).alias("_exact_last"))
    ranked = with_row_index(keyed, ["_exact_last", F.col("score").desc(), "sheet_id", "first_pos"], "rank")
    return ranked.select(
        "rank", "sheet_id", "first_pos", "vendor_norm",
        F.coalesce("vendor", F.lit("")).alias("vendor"),
        F.coalesce("supplier", F.lit("")).alias("supplier"),
        "match_type", "score", "amount_added")


def match_counts(report: DataFrame) -> DataFrame:
    """Rows per match type, with the number of distinct vendor norms."""
    vendors = report.groupBy("match_type").agg(F.countDistinct("vendor_norm").alias("n_vendors"))
    sums = grouped_sum(report, ["match_type"], "amount_added", "amount", {"n_rows": (F.count(F.lit(1)), F.sum)})
    return sums.join(vendors, "match_type").select("match_type", "n_rows", "n_vendors", "amount")


def unmatched_vendors(report: DataFrame) -> DataFrame:
    """Vendors without a supplier and the amount they carried."""
    return (report.where(F.col("match_type") == "no_match")
            .select("sheet_id", "first_pos", "vendor", F.col("amount_added").alias("amount")))
