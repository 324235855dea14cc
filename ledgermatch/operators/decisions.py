"""Ingest match decisions produced outside Spark (JSON text per request).

Parsing (F12/F13): optional leading code fence stripped; the whole text must be one JSON
array of objects ``{vendor, supplier, match_type, score, amount}``; missing ``match_type``
defaults to ``fuzzy``, missing, empty or null ``score`` and ``amount`` to 0; a score or
amount given as text is read as a number.  Every element ends in exactly one output: a
response that is no JSON array goes to the quarantine whole (``idx`` null), an element that
is no object, or whose score or amount is no finite number, goes there alone, with the
reason; all others are decisions (V6, V8).

Joining (J8): the supplier name is looked up *exactly* (case-sensitive, no
normalisation) against the first master row carrying that name; ``no_match``, a
missing supplier or an unknown name give a ``no_match`` row with null supplier and
score 0, the amount kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.responses import json_kind, strict_json, strip_code_fence

NOT_AN_ARRAY = "response is not a JSON array"
NOT_AN_OBJECT = "element is not a JSON object"
NOT_A_NUMBER = "score or amount is not a number"


def _texts(responses: DataFrame) -> DataFrame:
    v = strict_json(strip_code_fence("response"))
    return responses.select("request_id", "response", v.alias("json")).withColumn(
        "is_array", F.coalesce(json_kind("json") == "ARRAY", F.lit(False)))


def _number(field: str) -> tuple[Column, Column]:
    """Value of a numeric field (0 if missing, null or empty), and whether it can be read."""
    text = F.try_variant_get("e", f"$.{field}", "string")
    value = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return value, F.coalesce(F.abs(value) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(value, F.lit(0.0)))


def _elements(responses: DataFrame) -> DataFrame:
    """One row per array element: its fields and ``reason`` (null if it is a decision)."""
    e = _texts(responses).where("is_array").select("request_id", F.posexplode(F.col("json").cast("array<variant>")).alias("idx", "e"))
    (score, score_fine), (amount, amount_fine) = _number("score"), _number("amount")
    text = lambda field: F.try_variant_get("e", f"$.{field}", "string")
    is_object = F.coalesce(json_kind("e") == "OBJECT", F.lit(False))
    reason = F.when(~is_object, F.lit(NOT_AN_OBJECT)).when(~(score_fine & amount_fine), F.lit(NOT_A_NUMBER))
    return e.select("request_id", "idx", text("vendor").alias("vendor"), text("supplier").alias("supplier"),
                    F.coalesce(F.nullif(text("match_type"), F.lit("")), F.lit("fuzzy")).alias("match_type"),
                    score.alias("score"), amount.alias("amount"), reason.alias("reason"),
                    F.coalesce(F.to_json("e"), F.lit("null")).alias("element"))


def quarantined_responses(responses: DataFrame) -> DataFrame:
    """What is no decision: ``request_id, idx`` (null: the whole response), ``reason`` and the
    text of the response or element."""
    whole = _texts(responses).where("not is_array").select(
        "request_id", F.lit(None).cast("int").alias("idx"), F.lit(NOT_AN_ARRAY).alias("reason"), "response")
    single = _elements(responses).where("reason is not null").select(
        "request_id", "idx", "reason", F.col("element").alias("response"))
    return whole.unionByName(single)


def parse_decisions(responses: DataFrame) -> DataFrame:
    """One row per decision: ``request_id, idx`` (0-based) and the defaulted fields."""
    return _elements(responses).where("reason is null").drop("reason", "element")


def first_row_by_name(master: DataFrame) -> DataFrame:
    """A4: distinct raw supplier names with their first master row."""
    return master.groupBy("supplier").agg(F.min("row_pos").alias("supplier_pos"))


def decisions_report(decisions: DataFrame, master: DataFrame) -> DataFrame:
    """Report rows for decisions that name a vendor."""
    d = decisions.where(F.col("vendor").isNotNull() & (F.col("vendor") != ""))
    names = first_row_by_name(master.where(F.col("supplier").isNotNull()))
    j = d.join(names, "supplier", "left")
    none = ((F.col("match_type") == "no_match") | F.col("supplier").isNull() | (F.col("supplier") == "")
            | F.col("supplier_pos").isNull())
    return j.select(
        "request_id", "idx", "vendor",
        F.when(none, F.lit(None).cast("string")).otherwise(F.col("supplier")).alias("supplier"),
        F.when(none, F.lit("no_match")).otherwise(F.col("match_type")).alias("match_type"),
        F.when(none, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.col("amount").alias("amount_added"),
        F.when(none, F.lit(None).cast("long")).otherwise(F.col("supplier_pos")).alias("supplier_pos"),
    )
