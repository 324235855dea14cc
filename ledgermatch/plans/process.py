"""One entry point for both matching paths (the reference's request handler, minus HTTP).

``method``: ``"fuzzy"`` runs X1 (reconcile); ``"decisions"`` applies externally produced
match decisions (X2).  ``similarity_threshold`` must be a number in 0..100 (the
reference silently falls back to 85 on bad input; declared deviation V2 raises).
The fuzzy path applies the threshold only when ``apply_threshold`` is set, as the
reference code never reads it (SURVEY D1).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgermatch.plans.decisions import apply_decisions
from ledgermatch.plans.reconcile import reconcile
from ledgermatch.plans.requests import MatchRequests, build_match_requests
from ledgermatch.sources.sheets import MASTER_COLUMNS, SHEET_COLUMNS, require_columns

DEFAULT_SIMILARITY_THRESHOLD = 85
METHODS = ("fuzzy", "decisions")


@dataclass
class ProcessResult:
    updated_master: DataFrame
    match_report: DataFrame
    quarantine: DataFrame | None = None


def coerce_threshold(value) -> float:
    """Parse a 0..100 threshold; anything else raises."""
    if value is None or value == "":
        return DEFAULT_SIMILARITY_THRESHOLD
    try:
        t = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"similarity_threshold must be a number, got {value!r}") from None
    if not (0 <= t <= 100):
        raise ValueError(f"similarity_threshold must be within 0..100, got {value!r}")
    return t


def coerce_method(value) -> str:
    """Method name, case-insensitive; unknown names raise."""
    m = (value or "fuzzy").strip().lower()
    if m not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {value!r}")
    return m


def prepare_requests(master: DataFrame, sheets: DataFrame, similarity_threshold=None, **sizes) -> MatchRequests:
    """The requests for an external matcher whose answers ``process(method="decisions")``
    takes; the threshold is part of every request's text."""
    threshold = coerce_threshold(similarity_threshold)
    require_columns(master, MASTER_COLUMNS + ["row_pos"], "Universal Database")
    require_columns(sheets, SHEET_COLUMNS + ["sheet_id", "row_pos"], "Vendor sheet")
    return build_match_requests(master, sheets, threshold=threshold, **sizes)


def process(master: DataFrame, sheets: DataFrame | None = None, method: str = "fuzzy",
            similarity_threshold=None, responses: DataFrame | None = None,
            apply_threshold: bool = False, tiers=("exact", "fuzzy")) -> ProcessResult:
    m = coerce_method(method)
    threshold = coerce_threshold(similarity_threshold)
    if m == "decisions":
        if responses is None:
            raise ValueError("method 'decisions' needs a responses table")
        r = apply_decisions(master, responses)
        return ProcessResult(r.updated_master, r.match_report, r.quarantine)
    if sheets is None:
        raise ValueError("method 'fuzzy' needs a sheets table")
    # scores are whole numbers: the least one that reaches the threshold
    min_score = math.ceil(threshold) if apply_threshold else None
    r = reconcile(master, sheets, tiers=tiers, min_score=min_score)
    return ProcessResult(r.updated_master, r.match_report)
