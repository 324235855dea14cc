"""ledgermatch: invoice-sheet reconciliation against a supplier master, on Spark.

Layout
------
functions/  Column-level scalar functions (name normalisation, amount parsing,
            similarity scores, CSV rendering, JSON response handling, keyword screens).
operators/  DataFrame operators (ordered sheet scan, matching tiers, blocking,
            rollups, decision ingest, screening).
sources/    Readers/writers and the derived fixture tables.
plans/      User-level pipelines composed from the operators.

Everything is built from built-in Spark SQL expressions, but for two numpy helpers inside
tasks (``operators.bounded``, ``operators.keyword_index``).
"""

from ledgermatch.session import ensure_checkpoint_dir, get_session, materialize


def __getattr__(name):
    # pipelines are imported lazily so that ``import ledgermatch`` stays light
    if name == "reconcile":
        from ledgermatch.plans.reconcile import reconcile
        return reconcile
    if name == "apply_decisions":
        from ledgermatch.plans.decisions import apply_decisions
        return apply_decisions
    if name == "build_match_requests":
        from ledgermatch.plans.requests import build_match_requests
        return build_match_requests
    if name == "screen_text":
        from ledgermatch.plans.screening import screen_text
        return screen_text
    if name == "process":
        from ledgermatch.plans.process import process
        return process
    raise AttributeError(name)


__all__ = ["get_session", "ensure_checkpoint_dir", "materialize", "reconcile", "apply_decisions",
           "build_match_requests", "screen_text", "process"]
