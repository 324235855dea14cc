"""Distributed row numbering (no single-partition window).

``with_row_index`` numbers rows 1..n in a given total order, optionally restarting per
group.  Rows are range-partitioned and sorted on the order key, each row's position
inside its partition is recorded, the table is materialised (so positions are fixed
even if tasks are retried), and per-partition counts -- one row per (group,
partition), bounded by the partition count -- give the offsets.

``first_rows_per_sheet`` keeps the first k rows of every sheet by ``row_pos`` using the
same block layout as the sheet scan: block row counts, a prefix over blocks, and a
window over single blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.operators.sheet import DEFAULT_ROWS_PER_BLOCK
from ledgermatch.session import materialize


def with_row_index(df: DataFrame, order_cols: list, name: str = "idx", group_cols=()) -> DataFrame:
    """Append ``name`` = 1-based position in ``order_cols`` order (within ``group_cols``).

    ``group_cols + order_cols`` must identify rows uniquely for the numbering to be
    deterministic.  ``order_cols`` may hold Columns (e.g. ``F.col("x").desc()``).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in list(group_cols)] + \
           [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    placed = ranged.select("*", pid.alias("_pid"),
                           (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_pos"))
    placed = materialize(placed, "row-index")
    g = list(group_cols)
    counts = placed.groupBy(*g, "_pid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if g else \
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "_pid", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per (group, partition): bounded by the partition count per group
    out = placed.join(F.broadcast(offsets) if not g else offsets, [*g, "_pid"])
    return out.select(*df.columns, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).alias(name))


def with_running_total(df: DataFrame, value: Column, order_cols: list, name: str, group_cols=()) -> DataFrame:
    """Append ``name`` = the sum of ``value`` over the rows before, in ``order_cols`` order
    within ``group_cols`` (null counts as 0).  Windows run over single range partitions and
    over one row per (group, partition), never over a whole group."""
    g = list(group_cols)
    keys = [F.col(c) if isinstance(c, str) else c for c in g + list(order_cols)]
    pid = F.spark_partition_id()
    placed = df.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.select("*", pid.alias("_pid"), F.monotonically_increasing_id().alias("_at")), "running-total")
    w = Window.partitionBy(*g, "_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    wp = (Window.partitionBy(*g) if g else Window).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*g, "_pid").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*g, "_pid", F.coalesce(F.sum("_sum").over(wp), F.lit(0)).alias("_off"))
    out = placed.withColumn("_own", F.coalesce(F.sum("_value").over(w), F.lit(0))).join(sums, [*g, "_pid"])
    return out.select(*df.columns, (F.col("_off") + F.col("_own")).alias(name))


def sheet_key() -> Column:
    """A sheet's key that is never null: a null sheet id is a sheet, too."""
    return F.when(F.col("sheet_id").isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("s"), F.col("sheet_id").cast("string")))


def first_rows_per_sheet(sheet: DataFrame, k: int,
                         rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """The first ``k`` rows of every sheet by ``row_pos``, with ``row_idx`` 1..k."""
    blk = F.expr(f"row_pos div {int(rows_per_block)}")
    b = sheet.withColumn("_blk", blk).withColumn("_key", sheet_key())
    counts = b.groupBy("_key", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_blk", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_before"))
    head_blocks = before.where(F.col("_before") < k)
    rows = b.join(head_blocks, ["_key", "_blk"])
    w = Window.partitionBy("_key", "_blk").orderBy("row_pos")
    idx = F.col("_before") + F.row_number().over(w)
    return (rows.select(*sheet.columns, idx.alias("row_idx"))
            .where(F.col("row_idx") <= k))
