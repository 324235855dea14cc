"""JSON responses produced outside Spark (match decisions, moderation verdicts).

Two fence conventions exist in the reference:

* match decisions: trim; if the text starts with a fence line (```` ```json ```` or
  ```` ``` ````) drop it and a trailing fence;
* moderation verdicts: if the text contains a fence anywhere, take the part between
  the first fence and the next one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.text import _col, js_trim

FENCE = "```"


def strict_json(c) -> Column:
    """The text as a VARIANT if all of it is one JSON value, else null.

    Spark's JSON functions stop after the first value.  Put into an object and into an
    array, a text with anything behind its value breaks one of the two."""
    t = _col(c)
    whole = ((F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1)
             & (F.json_object_keys(F.concat(F.lit('{"v":'), t, F.lit("}"))) == F.array(F.lit("v"))))
    return F.when(F.coalesce(whole, F.lit(False)), F.try_parse_json(t))


def json_kind(v) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID, ... of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def strip_code_fence(c) -> Column:
    """Leading-fence variant (match decisions)."""
    t = js_trim(_col(c))
    json_fenced = F.regexp_replace(F.regexp_replace(t, r"^```json\n?", ""), r"\n?```\z", "")
    plain_fenced = F.regexp_replace(F.regexp_replace(t, r"^```\n?", ""), r"\n?```\z", "")
    return (F.when(t.startswith("```json"), json_fenced)
            .when(t.startswith(FENCE), plain_fenced).otherwise(t))


def extract_fenced(c) -> Column:
    """Between-first-fences variant (moderation verdicts)."""
    t = js_trim(_col(c))
    after_json = F.split_part(t, F.lit("```json"), F.lit(2))
    after_plain = F.split_part(t, F.lit(FENCE), F.lit(2))
    return (F.when(F.contains(t, F.lit("```json")),
                   js_trim(F.split_part(after_json, F.lit(FENCE), F.lit(1))))
            .when(F.contains(t, F.lit(FENCE)), js_trim(after_plain))
            .otherwise(t))
