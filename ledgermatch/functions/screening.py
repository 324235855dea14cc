"""Text screening: keyword flags, verdict construction and warning text.

A verdict is a struct ``(is_offensive, message, details, severity, flagged_words)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.text import _col, is_blank

# --- fixed values (must equal the reference behaviour) -----------------------------
# Keyword list of the fallback screen, in the reference's order (lower-case substrings).
FALLBACK_KEYWORDS = ["fuck", "porn", "shit", "damn", "bitch", "asshole", "cunt", "nigger", "faggot"]
WARNING_PREFIX = "⚠️ Using offensive language is prohibited. "
SERIOUS_SENTENCE = "This is a serious violation. "
WARNING_SUFFIX = "If continued, you will be removed permanently."
MSG_EMPTY = "Content is valid"
DETAILS_EMPTY = "Empty or invalid input"
DETAILS_FALLBACK_HIT = "Detected potentially offensive content (fallback detection)"
MSG_FALLBACK_CLEAN = "Content check completed"
DETAILS_FALLBACK_CLEAN = "API error, but no obvious offensive content detected"
MSG_CLEAN = "Content is appropriate"
DETAILS_CLEAN = "No offensive content detected"
DETAILS_OFFENSIVE = "Contains offensive content"
DEFAULT_SEVERITY = "medium"
FLAGGED_PREFIX = "\nFlagged words: "
# ---------------------------------------------------------------------------------


def flag_keywords(text, keywords=None) -> Column:
    """Keywords (in list order) that occur as lower-case substrings of the text."""
    chosen = FALLBACK_KEYWORDS if keywords is None else keywords
    kws = F.array(*[F.lit(k) for k in chosen]).cast("array<string>")
    lowered = F.lower(_col(text))
    return F.filter(kws, lambda k: F.contains(lowered, k))


def _verdict(is_offensive, message, details, severity, flagged) -> Column:
    return F.struct(
        _as_col(is_offensive).cast("boolean").alias("is_offensive"),
        _as_col(message).cast("string").alias("message"),
        _as_col(details).cast("string").alias("details"),
        _as_col(severity).cast("string").alias("severity"),
        _as_col(flagged).cast("array<string>").alias("flagged_words"),
    )


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _empty_words() -> Column:
    return F.array().cast("array<string>")


def blank_verdict() -> Column:
    return _verdict(False, MSG_EMPTY, DETAILS_EMPTY, None, _empty_words())


def keyword_verdict(text, keywords=None) -> Column:
    """Fallback screen when no usable verdict exists for the text."""
    found = flag_keywords(text, keywords)
    hit = F.size(found) > 0
    return F.when(hit, _verdict(True, WARNING_PREFIX + WARNING_SUFFIX, DETAILS_FALLBACK_HIT,
                                DEFAULT_SEVERITY, found)
                  ).otherwise(_verdict(False, MSG_FALLBACK_CLEAN, DETAILS_FALLBACK_CLEAN, "none",
                                       _empty_words()))


def parsed_verdict(parsed) -> Column:
    """Verdict from a parsed response struct (``isOffensive, severity, reason, flaggedWords``)."""
    p = _col(parsed)
    severity = F.coalesce(F.when(p["severity"] != "", p["severity"]), F.lit(DEFAULT_SEVERITY))
    message = F.concat(F.lit(WARNING_PREFIX),
                       F.when(severity == "high", F.lit(SERIOUS_SENTENCE)).otherwise(F.lit("")),
                       F.lit(WARNING_SUFFIX))
    reason = F.when(p["reason"] != "", p["reason"])
    return F.when(F.coalesce(p["isOffensive"], F.lit(False)), _verdict(
        True, message, F.coalesce(reason, F.lit(DETAILS_OFFENSIVE)), severity,
        F.coalesce(p["flaggedWords"], _empty_words()))
    ).otherwise(_verdict(False, MSG_CLEAN, F.coalesce(reason, F.lit(DETAILS_CLEAN)), "none",
                         _empty_words()))


def screen_verdict(text, parsed=None, keywords=None) -> Column:
    """Blank text -> valid; else the parsed verdict when present; else the keyword screen."""
    fallback = keyword_verdict(text, keywords)
    chosen = fallback if parsed is None else F.when(_col(parsed).isNotNull(), parsed_verdict(parsed)
                                                    ).otherwise(fallback)
    return F.when(is_blank(text), blank_verdict()).otherwise(chosen)


def warning_message(verdict) -> Column:
    """Display text: the message, plus ``\\nFlagged words: a, b`` for offensive verdicts."""
    v = _col(verdict)
    flagged = F.coalesce(v["flagged_words"], _empty_words())
    with_words = F.when(F.size(flagged) > 0, F.concat(
        v["message"], F.lit(FLAGGED_PREFIX), F.array_join(flagged, ", "))).otherwise(v["message"])
    return F.when(v["is_offensive"], with_words).otherwise(v["message"])
