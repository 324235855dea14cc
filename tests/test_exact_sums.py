"""Sums that do not depend on order or partitions, against math.fsum and decimal."""

import math
import random
import struct
from decimal import Decimal

from ledgermatch.functions.amounts import grouped_sum
from pyspark.sql import functions as F


def groups():
    rng = random.Random(3)
    any_double = lambda: struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
    out = {
        "ties": [1.0, 2.0**-53], "up": [1.0, 2.0**-53, 2.0**-1074], "down": [1.0, 2.0**-53, -(2.0**-1074)],
        "cancel": [1e308, 1e-300, -1e308, 3.0], "tiny": [5e-324] * 3 + [-1e-323], "low": [2.0**-1022, -5e-324],
        "zero": [0.0, -0.0, 1e300, -1e300], "large": [1.7976931348623157e308, -5e291, 1e292],
        "cents": [0.1] * 10 + [0.2], "one": [1e30], "negative": [-1e30, -1e-30, -7.5],
        "powers": [2.0**e for e in range(-1074, 1000, 13)] + [-(2.0**e) for e in range(-1070, 900, 7)]}
    for k in range(30):
        out[f"any{k}"] = [x for x in (any_double() for _ in range(60)) if math.isfinite(x) and abs(x) < 1e300]
        e = rng.randint(-300, 300)
        out[f"near{k}"] = [rng.uniform(-1, 1) * 10.0**e for _ in range(200)]
    return out


def sums(spark, rows, n, **how):
    df = spark.createDataFrame(rows, "k string, x double").repartition(n)
    got = grouped_sum(df, ["k"], "x", "s", {"n": (F.count(F.lit(1)), F.sum), "top": (F.max("x"), F.max)}, **how).collect()
    assert {r.k: r.n for r in got} == {k: sum(a == k for a, _ in rows) for k, _ in rows}
    return {r.k: r.s for r in got}


def test_binary_sums_equal_fsum_in_any_order(spark):
    data = groups()
    rows = [(k, x) for k, xs in data.items() for x in xs]
    want = {k: math.fsum(xs) for k, xs in data.items()}
    for n in (1, 7):
        random.Random(n).shuffle(rows)
        assert sums(spark, rows, n, decimal=False) == want


def test_amounts_add_as_decimals_where_they_are(spark):
    rows = [("a", 0.1), ("a", 0.2), ("b", None), ("c", 1e30), ("c", 1.0), ("c", -1e30), ("d", 0.1), ("d", None), ("e", float("inf")), ("e", 1.0),
            ("f", float("inf")), ("f", float("-inf")), ("g", 1e-11), ("g", 1e-12), ("h", 1e308), ("h", 1e308), ("i", 0.0)]
    for n in (1, 5):
        got = sums(spark, rows, n)
        assert math.isnan(got.pop("f"))
        assert got == {"a": 0.3, "b": None, "c": 1.0, "d": 0.1, "e": math.inf, "g": math.fsum([1e-11, 1e-12]), "h": math.inf, "i": 0.0}
    rng = random.Random(1)
    cents = [("x", rng.randrange(-10**9, 10**9) / 100) for _ in range(5000)]
    assert sums(spark, cents, 9)["x"] == float(sum(Decimal(str(x)) for _, x in cents))
