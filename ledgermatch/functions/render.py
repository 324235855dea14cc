"""Text rendering used by the request builder and the CSV writer.

``csv_cell`` / ``csv_line`` reproduce the reference's CSV text: null becomes empty, a
cell is quoted only when it contains a comma, a double quote or a newline, quotes
are doubled, cells are joined by commas and lines by ``\\n``.  Spark's own CSV writer
defaults (backslash escapes, ``""`` for empty, trimming) differ, hence these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import exact_decimal
from ledgermatch.functions.text import _col


def csv_cell(c) -> Column:
    s = _col(c).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[,"\n]'), quoted).otherwise(s), F.lit(""))


def csv_line(*cols) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cols])


def csv_header(names) -> str:
    return ",".join(names)


def display_number(c) -> Column:
    """JavaScript-style text of an amount: plain digits, no trailing zeros, integers
    without a decimal point (``12345.67``, ``-5``, ``0``).  From 1e21, and where ten decimals
    do not hold the amount, the shortest text with an exponent (``1e+30``, ``1e-11``)."""
    plain = F.regexp_replace(exact_decimal(c, 1e21).cast("string"), r"(\.[0-9]*[1-9])0+$|\.0+$", "$1")
    short = F.regexp_replace(_col(c).cast("string"), r"\.0(?=E|$)", "")
    return F.coalesce(plain, F.replace(F.replace(short, F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+")))
