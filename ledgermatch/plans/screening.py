"""Screen texts (chat turns, documents) against a keyword list, preferring
externally produced verdicts where they exist."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgermatch.operators.screening import parse_verdicts, screen_texts


def screen_text(texts: DataFrame, text_col: str = "text", keywords=None,
                responses: DataFrame | None = None, id_col: str = "text_id") -> DataFrame:
    verdicts = None if responses is None else parse_verdicts(responses, id_col)
    return screen_texts(texts, text_col, keywords, verdicts, id_col if responses is not None else None)
