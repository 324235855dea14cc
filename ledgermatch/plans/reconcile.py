"""Reconcile invoice sheets against the supplier master.

Scan -> blocked sheet scan -> vendor blocks -> supplier index -> tier cascade on distinct
vendor norms -> report -> per-supplier sums -> master update.  Building runs jobs: the vendor
blocks, the index and each tier's decisions are staged; report and update stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgermatch.functions.scoring import Scorer, similarity
from ledgermatch.session import materialize
from ledgermatch.operators.matching import match_decisions, match_report, supplier_index
from ledgermatch.operators.rollup import supplier_totals, update_master
from ledgermatch.operators.sheet import DEFAULT_ROWS_PER_BLOCK, mark_rows, vendor_blocks
from ledgermatch.sources.sheets import MASTER_COLUMNS, SHEET_COLUMNS, require_columns


@dataclass
class Reconciliation:
    updated_master: DataFrame
    match_report: DataFrame


def reconcile(master: DataFrame, sheets: DataFrame, tiers=("exact", "fuzzy"),
              min_score: int | None = None, scorer: Scorer = similarity, min_shared_run: int = 3,
              rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> Reconciliation:
    """``min_score=None`` keeps the reference code's behaviour (best fuzzy candidate always
    accepted); ``min_score=85`` is the documented threshold contract."""
    require_columns(master, MASTER_COLUMNS + ["row_pos"], "Universal Database")
    require_columns(sheets, SHEET_COLUMNS + ["sheet_id", "row_pos"], "Vendor sheet")
    blocks = materialize(vendor_blocks(mark_rows(sheets, rows_per_block)), "vendor-blocks")
    suppliers = materialize(supplier_index(master), "supplier-index")
    decisions = match_decisions(blocks, suppliers, tiers, min_score, scorer, min_shared_run)
    report = match_report(blocks, decisions)
    return Reconciliation(update_master(master, supplier_totals(report)), report)
