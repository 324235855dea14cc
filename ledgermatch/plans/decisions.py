"""Apply externally produced match decisions to the supplier master."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgermatch.operators.decisions import decisions_report, parse_decisions, quarantined_responses
from ledgermatch.operators.rollup import supplier_totals, update_master


@dataclass
class DecisionResult:
    updated_master: DataFrame
    match_report: DataFrame
    quarantine: DataFrame


def apply_decisions(master: DataFrame, responses: DataFrame) -> DecisionResult:
    """Amounts come from the decisions (not the sheets); a vendor listed twice adds twice."""
    report = decisions_report(parse_decisions(responses), master)
    return DecisionResult(update_master(master, supplier_totals(report)), report,
                          quarantined_responses(responses))
