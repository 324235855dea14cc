"""Ordered invoice-sheet operators: forward fill, subtotal rows, vendor blocks.

Input: ``sheet_id, row_pos, vendor, invoice_amount`` (cells as text).  Row order inside
a sheet is data, carried by ``row_pos``.

Semantics (one pass over the rows of a sheet in ``row_pos`` order):

* a non-blank vendor becomes the *current vendor*;
* a blank-vendor row with a non-zero amount after some vendor is a **subtotal row**;
* a blank-vendor row without amount (null or 0) after some vendor is **filled** with
  the current vendor;
* a vendor's **last row** is its last non-subtotal row; its stated subtotal is the
  amount of the row right after it when that row is a subtotal row, else 0.  (A
  longer forward search can never find more: the next row is another vendor, a
  subtotal row, or would have been filled with the same vendor.)

Scale: a sheet may hold a large share of all rows, so nothing is windowed over a
whole sheet.  Rows are cut into blocks of ``rows_per_block`` consecutive positions;
one small aggregate per block gives the vendor carried into the block and the first
row of the following block, and the row-level windows run per ``(sheet_id, block)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import exact_difference, grouped_sum, has_amount, parse_amount
from ledgermatch.functions.text import is_blank, js_trim, normalize_name
from ledgermatch.session import materialize

DEFAULT_ROWS_PER_BLOCK = 1 << 20
#: Blocks of a sheet up to which one window carries vendors from block to block; positions
#: with wide gaps may make more.
BLOCKS_IN_A_WINDOW = 1 << 17


def _carried(df: DataFrame, group: list, order: str) -> DataFrame:
    """Per row: the last ``held`` before it in its group, and the ``head`` of the next row."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.select(*group, order, F.last("held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_vendor"),
                     F.lead("head").over(w).alias("next_first"))


def carried_over_parts(df: DataFrame, group: list, order: str) -> DataFrame:
    """The same for groups of any size: windows run over the range partitions of a group,
    and over one summary row for each of these."""
    placed = df.repartitionByRange(*group, order).sortWithinPartitions(*group, order)
    placed = materialize(placed.withColumn("_pid", F.spark_partition_id()), "sheet-blocks")
    inner = _carried(placed, [*group, "_pid"], order)
    ends = placed.groupBy(*group, "_pid").agg(
        F.max_by("held", F.when(F.col("held").isNotNull(), F.col(order))).alias("held"), F.min_by("head", order).alias("head"))
    outer = _carried(ends, group, "_pid").select(*group, "_pid", F.col("carry_vendor").alias("_before"), F.col("next_first").alias("_after"))
    rows = inner.join(outer, [*group, "_pid"])
    return rows.select(*group, order, F.coalesce("carry_vendor", "_before").alias("carry_vendor"),
                       F.coalesce("next_first", "_after").alias("next_first"))


def mark_rows(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Per row: parsed ``amount``, ``filled_vendor``, ``is_total``, ``vendor_norm`` (named
    rows only) and ``subtotal_after`` (stated subtotal if this row ends a vendor).

    Plan: one shuffle of the rows on ``(sheet, block)``; the block summary takes two more,
    pruned scans: the positions of each block's first and last named row (numbers only, so it
    is hashed), then the cells there; no rows are shuffled for it.  The carry window runs on
    the summary and is joined back on the same key.
    """
    base = sheet.select(
        "sheet_id", "row_pos", "vendor", "invoice_amount",
        parse_amount("invoice_amount").alias("amount"),
        is_blank("vendor").alias("blank"),
        F.expr(f"row_pos div {int(rows_per_block)}").alias("blk"),
        # joins and windows go by a key that is never null: a null sheet id is a sheet, too
        F.when(F.col("sheet_id").isNull(), F.lit("n"))
        .otherwise(F.concat(F.lit("s"), F.col("sheet_id").cast("string"))).alias("sheet_key"),
    )
    w = Window.partitionBy("sheet_key", "blk").orderBy("row_pos")
    local = base.select(
        "*",
        F.last(F.when(~F.col("blank"), F.col("vendor")), ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("local_vendor"),
        F.lead(F.struct("blank", "amount")).over(w).alias("local_next"),
    )
    ends = base.where(F.col("blk").isNotNull()).groupBy("sheet_key", "blk").agg(
        F.max(F.when(~F.col("blank"), F.col("row_pos"))).alias("_last"), F.min("row_pos").alias("_first"))
    ends = materialize(ends, "block-ends")
    at = ends.select("sheet_key", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("row_pos")).where("row_pos is not null")
    # a position may repeat
    found = base.select("sheet_key", "blk", "row_pos", "vendor", "invoice_amount").join(at, ["sheet_key", "row_pos"])
    found = found.withColumn("blank", is_blank("vendor")).withColumn("amount", parse_amount("invoice_amount"))
    cells = materialize(found.groupBy("sheet_key", "blk", "row_pos").agg(
        F.max(F.when(~F.col("blank"), F.col("vendor"))).alias("held"), F.min(F.struct("blank", "amount")).alias("head")), "block-cells")
    held = cells.select("sheet_key", "blk", F.col("row_pos").alias("_last"), "held")
    head = cells.select("sheet_key", "blk", F.col("row_pos").alias("_first"), "head")
    summary = ends.join(head, ["sheet_key", "blk", "_first"]).join(held, ["sheet_key", "blk", "_last"], "left").select(
        "sheet_key", "blk", "held", "head")
    span = sheet.agg(F.max("row_pos") - F.min("row_pos")).first()[0] or 0
    many = span // int(rows_per_block) > BLOCKS_IN_A_WINDOW
    carry = carried_over_parts(summary, ["sheet_key"], "blk") if many else _carried(summary, ["sheet_key"], "blk")
    rows = local.join(carry, ["sheet_key", "blk"], "inner").select(
        "sheet_id", "row_pos", "vendor", "invoice_amount", "amount", "blank",
        F.coalesce("local_vendor", "carry_vendor").alias("current_vendor"),
        F.coalesce("local_next", "next_first").alias("next_row"))
    is_total = F.col("blank") & F.col("current_vendor").isNotNull() & has_amount("amount")
    filled = (F.when(~F.col("blank"), F.col("vendor"))
              .when(F.col("current_vendor").isNotNull() & ~has_amount("amount"), F.col("current_vendor"))
              .otherwise(F.col("vendor")))
    subtotal_after = F.when(
        F.coalesce(F.col("next_row.blank"), F.lit(False)) & has_amount("next_row.amount"),
        F.col("next_row.amount")).otherwise(F.lit(0.0))
    # a filled or non-blank vendor is never blank, so "named" = has a vendor and is no subtotal
    marked = rows.select(
        "sheet_id", "row_pos", "vendor", "invoice_amount", "amount", "current_vendor",
        filled.alias("filled_vendor"), is_total.alias("is_total"), subtotal_after.alias("_sub"))
    named = F.col("current_vendor").isNotNull() & ~F.col("is_total")
    return marked.select(
        "sheet_id", "row_pos", "vendor", "invoice_amount", "amount", "filled_vendor", "is_total",
        F.when(named, normalize_name("filled_vendor")).alias("vendor_norm"),
        F.when(named, js_trim("filled_vendor")).alias("vendor_display"),
        F.when(named, F.col("_sub")).alias("subtotal_after"),
        F.when(F.col("is_total"), js_trim("current_vendor")).alias("block_vendor"),
    )


def forward_fill_vendor(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Every row with its filled vendor, parsed amount and subtotal flag."""
    return mark_rows(sheet, rows_per_block).select(
        "sheet_id", "row_pos", F.col("filled_vendor").alias("vendor"), "amount", "is_total")


def nonblank_vendors(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Rows whose (filled) vendor is not blank."""
    return (forward_fill_vendor(sheet, rows_per_block)
            .where(~is_blank("vendor")).select("sheet_id", "row_pos", "vendor", "amount"))


def subtotal_rows(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Subtotal rows with the vendor whose block they close."""
    return (mark_rows(sheet, rows_per_block).where("is_total")
            .select("sheet_id", "row_pos", "block_vendor", "invoice_amount", "amount"))


def vendor_blocks(marked: DataFrame) -> DataFrame:
    """A1/W3/W4/W5 on marked rows: one row per (sheet, vendor norm).

    ``vendor`` is the spelling at the last row, ``first_pos`` the first appearance,
    ``amount`` the stated subtotal after the last row, ``detail_total`` the sum of the
    vendor's own rows.  Aggregates are partial (map-side), so a hot vendor is not a
    hot task; rows are summed per spelling and subtotal first, by hash, and only the
    spellings are normalised.
    """
    named = marked.where(F.col("subtotal_after").isNotNull())  # named rows only, as vendor_norm
    agg = grouped_sum(named, ["sheet_id", "vendor_norm"], F.coalesce(F.col("amount"), F.lit(0.0)), "detail_total", {
        "first_pos": (F.min("row_pos"), F.min),
        "last": (F.max("row_pos"), F.max, lambda at: F.max(F.struct(at.alias("row_pos"), "vendor_display", "subtotal_after")))},
        finer=(["sheet_id", "filled_vendor", "subtotal_after"],
               {"vendor_norm": normalize_name("filled_vendor"), "vendor_display": js_trim("filled_vendor")}))
    return agg.select(
        "sheet_id", "vendor_norm", F.col("last.vendor_display").alias("vendor"), "first_pos",
        F.col("last.row_pos").alias("last_pos"), F.col("last.subtotal_after").alias("amount"),
        "detail_total",
    )


def distinct_vendors(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Distinct vendors of each sheet with display name and appearance span."""
    return vendor_blocks(mark_rows(sheet, rows_per_block)).select(
        "sheet_id", "vendor_norm", "vendor", "first_pos", "last_pos")


def vendor_subtotals(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Stated subtotal after each vendor's last row (0 when none)."""
    return vendor_blocks(mark_rows(sheet, rows_per_block)).select(
        "sheet_id", "vendor_norm", "vendor", "amount")


def section_totals(sheet: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Detail sum of each vendor's rows next to its stated subtotal."""
    b = vendor_blocks(mark_rows(sheet, rows_per_block))
    diff = exact_difference("detail_total", "amount")
    return b.select("sheet_id", "vendor_norm", "detail_total",
                    F.col("amount").alias("stated_subtotal"),
                    diff.alias("difference"), (diff == 0).alias("is_consistent"))
