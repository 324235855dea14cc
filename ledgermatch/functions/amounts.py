"""Currency text parsing and total arithmetic.

``parse_amount`` reproduces the reference's ``parseAmount`` on text input:

* blank -> null; ``(...)`` wrapping -> negative; every character except digits,
  ``.`` and ``-`` is dropped; the longest ``parseFloat`` numeric prefix is taken.
* ``1.2.3`` -> 1.2, ``12-34`` -> 12, ``--5`` -> null, ``(-5)`` -> 5, ``-(5)`` -> -5,
  ``1e5`` -> 15, ``1.234,56`` -> 1.23456, ``N/A`` -> null.

Sums are taken as DECIMAL so results do not depend on row order; the value is
converted back to DOUBLE once at the end.  Amounts that the DECIMAL does not hold (very
large ones, or with more than ten decimals) are summed exactly beside it (``grouped_sum``):
one odd cell neither fails the job nor turns into 0, nor makes the sum depend on the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions.text import JS_SPACE_CLASS, _col, is_blank

# Exact accumulator type for amounts (10 fractional digits keep inputs such as
# ``1.234,56`` -> 1.23456 exact).
SUM_TYPE = "decimal(38,10)"
# Larger amounts are added as DOUBLE; below, 10**13 rows fit the accumulator.
EXACT_BELOW = 1e15

_NUMERIC_PREFIX = r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
# "(...)" after trimming: optional spaces, "(", anything, ")", optional spaces.
_PARENTHESISED = rf"(?s)^{JS_SPACE_CLASS}*\(.*\){JS_SPACE_CLASS}*\z"


def parse_amount(c) -> Column:
    """Trimming and the removal of the outer parentheses are subsumed by dropping every
    character outside ``[0-9.-]``; a blank cell leaves an empty string, hence null."""
    x = _col(c)
    digits = F.regexp_replace(x, r"[^0-9.\-]", "")
    value = F.regexp_extract(digits, _NUMERIC_PREFIX, 1).try_cast("double")
    sign = F.when(x.rlike(_PARENTHESISED), F.lit(-1.0)).otherwise(F.lit(1.0))
    return value * sign


def has_amount(amount) -> Column:
    """Amount present and not zero."""
    a = _col(amount)
    return F.coalesce(a != 0, F.lit(False))


def exact_decimal(amount, below: float = EXACT_BELOW) -> Column:
    """The amount as DECIMAL if that is its very value, else null."""
    a = _col(amount)
    d = F.when(F.abs(a) < below, a.cast(SUM_TYPE))
    return F.when(d.cast("double") == a, d)


# A double that DECIMAL does not hold is q * 2^(32 bin - 1074) with a whole q below 2^86; q
# goes into two accumulators of its bin, hi * 2^43 + lo, so that every step is exact.
_BIN_BITS, _LOWEST, _HALF = 32, 1074, 43
_DIGITS = 70  # bins, and room for the carry of any number of rows


def _finite(a: Column) -> Column:
    return F.abs(a) <= 1.7976931348623157e308


def _bin(a: Column) -> Column:
    lowest_bit = F.floor(F.log2(F.abs(a))) - 53
    return F.when(_finite(a) & (a != 0), F.greatest(F.lit(0), F.floor((lowest_bit + _LOWEST) / _BIN_BITS)).cast("int"))


def _halves(a: Column, at: Column) -> tuple[Column, Column]:
    q = F.abs(a) / F.pow(F.lit(2.0), _BIN_BITS * at - _LOWEST)
    hi = F.floor(q / 2.0 ** _HALF)
    lo = (q - hi * F.lit(2.0 ** _HALF)).cast("bigint")
    sign = F.when(a < 0, -1).otherwise(1)
    return (hi * sign).cast("decimal(20,0)"), (lo * sign).cast("decimal(20,0)")


def _carried(bins: Column) -> Column:
    """(digits of 32 bits, lowest first; carry beyond) of sum S 2^(32 bin) over (bin, s)."""
    by_bin = F.map_from_entries(bins)
    wide = "decimal(38,0)"

    def step(acc: Column, i: Column) -> Column:
        v = (acc["carry"] + F.coalesce(F.try_element_at(by_bin, i), F.lit(0).cast(wide))).cast(wide)
        digit = F.pmod(v, F.lit(1 << _BIN_BITS).cast("decimal(20,0)"))
        carry = ((v - digit) / F.lit(1 << _BIN_BITS).cast("decimal(10,0)")).cast(wide)
        return F.struct(carry.alias("carry"), F.concat(acc["digits"], F.array(digit.cast("bigint"))).alias("digits"))

    start = F.struct(F.lit(0).cast(wide).alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_DIGITS - 1)), start, step)


def _rounded(digits: Column) -> Column:
    """The double nearest to sum digit 2^(32 i - 1074); ties to even.  The three highest
    digits and one bit for anything below them decide it."""
    top = F.aggregate(F.sequence(F.lit(0), F.lit(_DIGITS - 1)), F.lit(-1),
                      lambda h, i: F.when(F.get(digits, i) != 0, i).otherwise(h))

    def value(h: Column) -> Column:
        digit = lambda k: F.when(h >= k, F.get(digits, F.greatest(h - k, F.lit(0)))).otherwise(0).cast("decimal(12,0)")
        size = F.lit(1 << _BIN_BITS).cast("decimal(11,0)")
        head = ((digit(0) * size + digit(1)).cast("decimal(26,0)") * size + digit(2)).cast("decimal(37,0)")
        below = F.exists(F.slice(digits, 1, F.greatest(h - 2, F.lit(0))), lambda d: d != 0)
        whole = (head * 2 + F.when(below, 1).otherwise(0)).cast("double")
        return F.when(h < 0, 0.0).otherwise(whole * 2.0 ** -65 * F.pow(F.lit(2.0), _BIN_BITS * h - _LOWEST))

    return F.get(F.transform(F.array(top), value), 0)


def _sum_of_bins(bins: Column) -> Column:
    """Correctly rounded sum of the accumulators (bin, s); infinite beyond the largest double."""
    negated = F.transform(bins, lambda x: F.struct(x["bin"], (-x["s"]).alias("s")))

    def use(pos: Column) -> Column:
        neg = _carried(negated)
        return F.when(pos["carry"] < 0, -_rounded(neg["digits"])).otherwise(_rounded(pos["digits"]))

    return F.get(F.transform(F.array(_carried(bins)), use), 0)


_MERGED: dict = {}


def _merged_bins() -> Column:
    """``_sum_of_bins`` of the column ``__lm_bins``; a large expression, built once a session."""
    spark = SparkSession.getActiveSession()
    if spark not in _MERGED:
        _MERGED.clear()
        _MERGED[spark] = _sum_of_bins(F.col("__lm_bins"))
    return _MERGED[spark]


def grouped_sum(df: DataFrame, keys: list, amount, name: str, others: dict | None = None, decimal: bool = True,
                finer: tuple[list, dict] | None = None) -> DataFrame:
    """``df`` grouped by ``keys`` with ``name``, the sum of its amounts as DOUBLE (null if it
    has none), the same for any order and partitioning of the rows.

    Amounts that DECIMAL holds are added as DECIMAL (0.1 and 0.2 make 0.3).  Others, and all
    with ``decimal=False``, are added exactly as the binary numbers they are and rounded
    once, as ``math.fsum`` does: by exponent into the accumulators of up to 66 bins a group,
    merged at the end.  Infinite and NaN amounts make the sum what they would in any order.

    ``others``: name -> (aggregate of rows, aggregate that merges them), as the rows are
    grouped by (keys, bin) first, with map-side sums.  ``finer``: columns by which rows
    are grouped before that, and columns made of these for each such group; ``keys`` are among
    both, and a third aggregate, from these groups to (keys, bin), may use them.  Texts that an
    aggregate picks, and what is costly to make of them, belong there: an aggregate of numbers
    is hashed, one of texts sorts all rows."""
    a = _col(amount).cast("double")
    others = others or {}
    d = exact_decimal(a) if decimal else F.lit(None).cast(SUM_TYPE)
    rows = df.withColumn("__lm_d", d).withColumn("__lm_a", F.when(F.col("__lm_d").isNull(), a))
    rows = rows.withColumn("__lm_bin", _bin(F.col("__lm_a")))
    hi, lo = _halves(F.col("__lm_a"), F.col("__lm_bin"))
    odd = F.col("__lm_bin").isNotNull()
    parts = rows.groupBy(*(finer[0] if finer else keys), "__lm_bin").agg(
        F.sum("__lm_d").alias("__lm_d"), F.sum(F.when(odd, hi)).alias("__lm_hi"), F.sum(F.when(odd, lo)).alias("__lm_lo"),
        # zeros and what is not finite have no bin
        F.sum(F.when(~odd, F.col("__lm_a"))).alias("__lm_plain"), *(how[0].alias(n) for n, how in others.items()))
    if finer:
        exact = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in ("__lm_d", "__lm_hi", "__lm_lo")]
        parts = parts.withColumns(finer[1]).groupBy(*keys, "__lm_bin").agg(*exact, F.sum("__lm_plain").alias("__lm_plain"),
                                                     *(how[-1](F.col(n)).alias(n) for n, how in others.items()))
    s = (F.col("__lm_hi") * F.lit(1 << _HALF).cast("decimal(14,0)") + F.col("__lm_lo")).cast("decimal(38,0)")
    merged = parts.groupBy(*keys).agg(
        F.sum("__lm_d").cast("double").alias("__lm_d"), F.sum("__lm_plain").alias("__lm_plain"),
        # at most one row a bin
        F.collect_list(F.when(odd, F.struct(F.col("__lm_bin").alias("bin"), s.alias("s")))).alias("__lm_bins"),
        *(how[1](F.col(n)).alias(n) for n, how in others.items()))
    rest = F.when(F.size("__lm_bins") > 0, _merged_bins())
    total = reduce(lambda x, y: F.coalesce(x + y, x, y), [rest, F.col("__lm_d"), F.col("__lm_plain")])
    return merged.select(*keys, *others, total.alias(name))


def exact_difference(a, b) -> Column:
    """``a - b`` as DOUBLE, by DECIMAL where both are held exactly."""
    return F.coalesce((exact_decimal(a) - exact_decimal(b)).cast("double"), _col(a) - _col(b))


def null_preserving_total(original_text, total) -> Column:
    """Updated total: null when the original cell was blank and the new total is 0."""
    t = _col(total)
    return F.when(is_blank(original_text) & (t == 0), F.lit(None).cast("double")).otherwise(t)
