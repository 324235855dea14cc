"""Match-request batches (the text handed to an external matcher).

``build_match_requests`` sends everything: per sheet, the distinct vendors are numbered in
first-appearance order and packed by size into batches.  The context of a batch (the
numbered list of the distinct supplier names, the master and the batch's sheet rendered as
CSV) is cut into chunks of ``chunk_lines`` lines that are stored once under the hash of their
text; a table tells which chunks belong to the master and to each sheet.  So the output
grows with the inputs, not with batches x master, and no cell grows with the tables.

``build_bounded_requests`` sends one row per batch with a head of the context: the first
``max_suppliers`` names (with an overflow note), and the first ``max_chars`` characters of
the master and of the sheet (with a truncation marker).  Only batch-sized lists and the
first rows are ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.render import csv_cell, display_number
from ledgermatch.operators.decisions import first_row_by_name
from ledgermatch.operators.ordering import first_rows_per_sheet, sheet_key, with_row_index, with_running_total
from ledgermatch.operators.sheet import DEFAULT_ROWS_PER_BLOCK, mark_rows, vendor_blocks
from ledgermatch.session import materialize
from ledgermatch.sources.sheets import COLUMN_TO_HEADER

# --- fixed values (must equal the reference behaviour) -----------------------------
MAX_CHARS = 5000
MAX_SUPPLIERS = 100
TRUNCATION_MARKER = "\n... (truncated for display)"
OVERFLOW_NOTE = "... and {n} more suppliers"
VENDOR_LINE = '%d. "%s" (Amount: %s)'
SUPPLIER_LINE = '%d. "%s"'
# ---------------------------------------------------------------------------------

#: Characters of vendor lines in a batch.
BATCH_CHARS = 4000
PARTS = ("suppliers", "master", "sheet", "vendors")
REQUEST_LEAD = (
    "Find the supplier of each of the %d vendors below. Take a supplier only if your score for it is at least %s of 100; "
    "else answer match_type no_match with supplier null. Write supplier names exactly as they are listed. "
    "Answer with a JSON array of objects with the keys vendor, supplier, match_type, score and amount.")


def _csv_text(rows: DataFrame, cols: list, order_col: str, group_cols=(), max_chars: int = MAX_CHARS):
    """Header + lines (``\\n``-joined) cut to ``max_chars`` + marker; computed from the
    first ``max_chars`` rows only, the full length from an aggregate over all rows."""
    header = ",".join(COLUMN_TO_HEADER.get(c, c) for c in cols)
    line = F.concat_ws(",", *[csv_cell(c) for c in cols])
    g = list(group_cols)
    full_len = rows.groupBy(*g).agg(
        (F.lit(len(header)) + F.sum(F.length(line) + 1)).alias("_full_len"))
    return full_len, line, header


def _chunks(lines: DataFrame, part: str, chunk_lines: int, header: str | None = None) -> DataFrame:
    """``lines`` (scope, n from 1, line) as numbered chunks: part, scope, chunk_no, text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    if header is not None:
        text = F.when(F.col("chunk_no") == 0, F.concat(F.lit(header + "\n"), text)).otherwise(text)
    return (lines.withColumn("chunk_no", F.expr(f"(n - 1) div {int(chunk_lines)}"))
            .groupBy("scope", "chunk_no").agg(text.alias("text")).withColumn("part", F.lit(part)))


def _csv_lines(cols: list) -> tuple[Column, str]:
    return F.concat_ws(",", *[csv_cell(c) for c in cols]), ",".join(COLUMN_TO_HEADER.get(c, c) for c in cols)


@dataclass
class MatchRequests:
    """Requests as three tables whose sizes add up to those of the inputs.

    batches   sheet_id, batch_no, first_n, n_vendors, n_unique_vendors, n_suppliers, text:
              the instruction with the threshold and the batch's numbered vendor lines
    contexts  part (suppliers, master or sheet), sheet_id (null for the master's parts),
              sheet_key, chunk_no from 0, chunk_id: what a batch's request holds beside
    chunks    chunk_id (SHA-256 of the text), text: each text once
    """

    batches: DataFrame
    contexts: DataFrame
    chunks: DataFrame


def build_match_requests(master: DataFrame, sheets: DataFrame, batch_chars: int = BATCH_CHARS, chunk_lines: int = 100,
                         threshold: float = 85, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> MatchRequests:
    """A sheet's distinct vendors in first-appearance order, packed into batches by the
    size of their lines: a batch takes the lines that begin within its ``batch_chars``
    characters of the sheet's list.  (A line longer than that leaves a number unused.)
    ``rebuild_request`` puts one batch's whole request together."""
    blocks = vendor_blocks(mark_rows(sheets, rows_per_block)).withColumn("sheet_key", sheet_key())
    numbered = with_row_index(blocks.select("sheet_id", "sheet_key", "first_pos", "vendor", "amount"),
                              ["first_pos"], "n", group_cols=["sheet_key"])
    line = F.format_string(VENDOR_LINE, F.col("n"), F.col("vendor"), display_number("amount"))
    lines = with_running_total(numbered.select("sheet_id", "sheet_key", "n", line.alias("line")), F.length("line") + 1,
                               ["n"], "before", ["sheet_key"])
    lines = materialize(lines, "request-lines")
    totals = lines.groupBy("sheet_key").agg(F.max("n").alias("n_unique_vendors"))

    names = with_row_index(first_row_by_name(master).select("supplier", "supplier_pos"), ["supplier_pos"], "n")
    names = names.select(F.lit("").alias("scope"), "n", F.format_string(
        SUPPLIER_LINE, F.col("n"), F.coalesce("supplier", F.lit("null"))).alias("line"))
    m_line, m_header = _csv_lines([c for c in master.columns if c != "row_pos"])
    m_lines = with_row_index(master.select("row_pos", m_line.alias("line")), ["row_pos"], "n").select(
        F.lit("").alias("scope"), "n", "line")
    s_line, s_header = _csv_lines([c for c in sheets.columns if c not in ("row_pos", "sheet_id")])
    s_lines = with_row_index(sheets.select(sheet_key().alias("scope"), "row_pos", s_line.alias("line")),
                             ["row_pos"], "n", group_cols=["scope"])
    texts = materialize(
        _chunks(names, "suppliers", chunk_lines).unionByName(_chunks(m_lines, "master", chunk_lines, m_header))
        .unionByName(_chunks(s_lines, "sheet", chunk_lines, s_header)).withColumn("chunk_id", F.sha2("text", 256)), "request-chunks")
    ids = totals.join(lines.groupBy("sheet_key").agg(F.max("sheet_id").alias("sheet_id")), "sheet_key").select(
        F.col("sheet_key").alias("scope"), "sheet_id")
    contexts = texts.drop("text").join(ids, "scope", "left").select(
        "part", "sheet_id", F.when(F.col("scope") != "", F.col("scope")).alias("sheet_key"), "chunk_no", "chunk_id")

    n_suppliers = names.count()
    batches = lines.groupBy("sheet_id", "sheet_key", F.expr(f"before div {int(batch_chars)}").alias("batch_no")).agg(
        F.count(F.lit(1)).alias("n_vendors"), F.min("n").alias("first_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    lead = F.format_string(REQUEST_LEAD, F.col("n_vendors"), F.lit(f"{threshold:g}"))
    batches = batches.join(totals, "sheet_key").select(
        "sheet_id", "sheet_key", "batch_no", "first_n", "n_vendors", "n_unique_vendors",
        F.lit(n_suppliers).cast("bigint").alias("n_suppliers"), F.concat(lead, F.lit("\n"), "lines").alias("text"))
    return MatchRequests(batches, contexts, texts.select("chunk_id", "text").dropDuplicates(["chunk_id"]))


def rebuild_request(requests: MatchRequests, sheet_id, batch_no: int) -> DataFrame:
    """(place, part, text): the pieces of one batch's request in order; joined by line feeds
    they are its whole text: suppliers, master, sheet, then the vendors asked for."""
    order = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("part"))
    same = F.col("sheet_id").eqNullSafe(F.lit(sheet_id))
    held = requests.contexts.where(F.col("sheet_key").isNull() | same).join(requests.chunks, "chunk_id")
    own = requests.batches.where(same & (F.col("batch_no") == batch_no)).select(F.lit("vendors").alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), "text")
    return held.select("part", "chunk_no", "text").unionByName(own).select(
        F.struct(order.alias("part"), "chunk_no").alias("place"), "part", "text").orderBy("place")


def build_bounded_requests(master: DataFrame, sheets: DataFrame, max_chars: int, max_suppliers: int,
                           batch_size: int = 50, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """One row per batch, its context cut to ``max_suppliers`` and ``max_chars``."""
    blocks = vendor_blocks(mark_rows(sheets, rows_per_block)).withColumn("sheet_key", sheet_key())
    numbered = with_row_index(blocks.select("sheet_id", "sheet_key", "first_pos", "vendor", "amount"),
                              ["first_pos"], "n", group_cols=["sheet_key"])
    line = F.format_string(VENDOR_LINE, F.col("n"), F.col("vendor"), display_number("amount"))
    batches = (numbered.select("sheet_id", "sheet_key", ((F.col("n") - 1) / F.lit(batch_size)).cast("long").alias("batch_no"),
                               "n", line.alias("line"))
               .groupBy("sheet_id", "sheet_key", "batch_no")
               .agg(F.count(F.lit(1)).alias("n_vendors"), F.min("n").alias("first_n"),
                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))),
                                             lambda x: x["line"]), "\n").alias("vendor_lines")))
    # numbers are dense 1..n per sheet, so the largest is the vendor count (no second scan)
    vendor_totals = numbered.groupBy("sheet_key").agg(F.max("n").alias("n_unique_vendors"))

    # supplier list: distinct raw names in first-appearance order (top-k is the feature)
    names = first_row_by_name(master)
    n_sup = names.select(F.count(F.lit(1))).scalar()
    top = names.orderBy("supplier_pos").limit(max_suppliers)
    sup_lines = top.select(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("supplier_pos", F.coalesce("supplier", F.lit("null")).alias("s")))),
        lambda x, i: F.format_string(SUPPLIER_LINE, i + 1, x["s"])), "\n").alias("t")).scalar()
    overflow = F.when(n_sup > max_suppliers, F.concat(
        F.lit(OVERFLOW_NOTE.split("{n}")[0]), (n_sup - max_suppliers).cast("string"),
        F.lit(OVERFLOW_NOTE.split("{n}")[1]))).otherwise(F.lit(""))

    # master CSV head
    mcols = [c for c in master.columns if c != "row_pos"]
    m_full, m_line, m_header = _csv_text(master, mcols, "row_pos")
    m_head = master.orderBy("row_pos").limit(max_chars).select(
        F.concat(F.lit(m_header + "\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("row_pos", m_line.alias("l")))), lambda x: x["l"]), "\n"))
        .alias("t")).scalar()
    m_len = m_full.select("_full_len").scalar()
    master_csv = F.when(m_len > max_chars, F.concat(F.substring(m_head, 1, max_chars), F.lit(TRUNCATION_MARKER))
                        ).otherwise(m_head)

    # sheet CSV heads (per sheet)
    scols = [c for c in sheets.columns if c not in ("row_pos", "sheet_id")]
    keyed = sheets.withColumn("sheet_key", sheet_key())
    s_full, s_line, s_header = _csv_text(keyed, scols, "row_pos", ["sheet_key"])
    s_head = (first_rows_per_sheet(keyed, max_chars, rows_per_block)
              .groupBy("sheet_key").agg(F.concat(F.lit(s_header + "\n"), F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("row_pos", s_line.alias("l")))), lambda x: x["l"]), "\n"))
                  .alias("_head")))
    sheet_csv = s_head.join(s_full, "sheet_key").select(
        "sheet_key", F.when(F.col("_full_len") > max_chars, F.concat(
            F.substring("_head", 1, max_chars), F.lit(TRUNCATION_MARKER))).otherwise(F.col("_head"))
        .alias("sheet_csv"))

    return (batches.join(vendor_totals, "sheet_key").join(sheet_csv, "sheet_key")
            .select("sheet_id", "batch_no", "first_n", "n_vendors", "n_unique_vendors", "vendor_lines",
                    n_sup.alias("n_suppliers"), sup_lines.alias("supplier_lines"),
                    overflow.alias("supplier_overflow"),
                    master_csv.alias("master_csv"), "sheet_csv"))
