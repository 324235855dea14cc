"""Best partner at any score without scoring every pair.

A scorer may declare how high it can get for two names, from their lengths and the number
of q-grams they share (``scorer.bound``, see ``functions.scoring``).  Names are cut into
blocks, vendors of ``VENDORS`` and suppliers of ``SUPPLIERS``; for each pair of blocks (a
tile) the shared q-grams of all its pairs are counted from inverted lists in numpy, and the
bound is taken from the counts.  Only pairs leave a tile:

1. the first round takes each vendor's ``FIRST`` highest bounds of each tile; their scores
   (JVM) give the vendor a best so far;
2. the second round takes every pair whose bound reaches the vendor's best so far.  A vendor
   is closed when no further bound does, so the best of both rounds is the best of all.

Tiles are sized, so tasks and memory stay even for any number of names; a common q-gram is
a long list in every tile but never a join key.  The work that grows with vendors x
suppliers is counting, about a tenth of a microsecond a pair, without a shuffle of pairs;
vendors with a partner above the segment join's thresholds never come here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.session import materialize, ship_code

VENDORS, SUPPLIERS = 512, 4096
#: Highest bounds of a vendor and tile that the first round scores.
FIRST = 16
#: Share of a tile's pairs from which a gram is counted by a matrix product.
COMMON = 1 / 64


def _tokens(name: str, q: int) -> list[tuple[str, int]]:
    """q-grams numbered by occurrence: shared tokens are shared occurrences."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(name) - q + 1):
        g = name[i:i + q]
        seen[g] = k = seen.get(g, 0) + 1
        out.append((g, k))
    return out


def _lists(names: list[str], q: int) -> dict[tuple[str, int], list[int]]:
    out: dict[tuple[str, int], list[int]] = {}
    for i, name in enumerate(names):
        for t in _tokens(name, q):
            out.setdefault(t, []).append(i)
    return out


def shared_grams(a: list[str], b: list[str], q: int) -> np.ndarray:
    """Number of shared q-gram occurrences of every pair (a row of ``a``, a row of ``b``)."""
    la, lb = _lists(a, q), _lists(b, q)
    out = np.zeros((len(a), len(b)), np.float32)
    common = []
    for t in la.keys() & lb.keys():
        if len(la[t]) * len(lb[t]) > COMMON * out.size:
            common.append(t)
        else:
            out[np.ix_(la[t], lb[t])] += 1
    for k in range(0, len(common), 1024):
        some = common[k:k + 1024]
        x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for j, t in enumerate(some):
            x[la[t], j] = 1
            y[lb[t], j] = 1
        out += x @ y.T
    return out


def _marked(name: str, q: int) -> str:
    """The name between q - 1 marks at either end, so that its ends count like its middle."""
    return "\x02" * (q - 1) + name + "\x03" * (q - 1)


class Shared:
    """What a bound may ask of a tile: ``shared(q)`` on the names as they are, and
    ``shared(q, words_sorted=True)`` on the names with their words sorted; counted once.  A
    name of n characters has n + q - 1 q-grams, as its ends are marked."""

    def __init__(self, a: list[str], b: list[str]):
        self.names = {False: (a, b)}
        self.known: dict[tuple[int, bool], np.ndarray] = {}

    def __call__(self, q: int, words_sorted: bool = False) -> np.ndarray:
        if (q, words_sorted) not in self.known:
            if words_sorted not in self.names:
                self.names[True] = tuple([" ".join(sorted(x.split(" "))) for x in side] for side in self.names[False])
            a, b = ([_marked(x, q) for x in side] for side in self.names[words_sorted])
            self.known[q, words_sorted] = shared_grams(a, b, q)
        return self.known[q, words_sorted]


def tile_bounds(a: list[str], b: list[str], bound: Callable, run: int) -> np.ndarray:
    """Bound of every pair; -1 for pairs without a shared run of ``run`` characters."""
    shared = Shared(a, b)
    n, m = (np.array([len(x) for x in side], np.float64) for side in (a, b))
    return np.where(shared_grams(a, b, run) > 0, bound(n[:, None], m[None, :], shared), -1.0)


def _within_lengths(a: list[str], b: list[str], least: np.ndarray, bound: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a tile with a pair that could reach ``least`` by lengths alone."""
    n, m = (np.array([len(x) for x in side], np.float64) for side in (a, b))
    n, m = n[:, None], m[None, :]
    most = bound(n, m, lambda q, words_sorted=False: np.minimum(n, m) + q - 1)
    ok = most >= least[:, None]
    return np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))


PAIRS = "vendor_norm string, supplier_norm string"


def _tile(bound: Callable, run: int, first: int | None, vendors: pa.Table, suppliers: pa.Table, among: Callable | None = None) -> pa.Table:
    a, b = vendors.column("names")[0].as_py(), suppliers.column("names")[0].as_py()
    rows, cols = np.arange(len(a)), np.arange(len(b))
    least = np.zeros(len(a))
    if first is None:
        least = np.array(vendors.column("least")[0].as_py(), np.float64)
        rows, cols = _within_lengths(a, b, least, bound)
    if not len(rows):
        return pa.table({"vendor_norm": pa.array([], pa.string()), "supplier_norm": pa.array([], pa.string())})
    some = [a[i] for i in rows], [b[j] for j in cols]
    if among is None:
        got = tile_bounds(*some, bound, run)
    else:
        mask = among(*some)
        got = np.where(mask, tile_bounds(*some, bound, run), -1.0) if mask.any() else np.full(mask.shape, -1.0)
    if first is None:
        i, j = np.nonzero((got >= 0) & (got >= least[rows][:, None]))
    else:
        top = np.argsort(-got, axis=1, kind="stable")[:, :first]
        i, j = np.repeat(np.arange(len(rows)), top.shape[1]), top.ravel()
        there = got[i, j] >= 0
        i, j = i[there], j[there]
    return pa.table({"vendor_norm": pa.array(a, pa.string()).take(pa.array(rows[i])),
                     "supplier_norm": pa.array(b, pa.string()).take(pa.array(cols[j]))})


def _blocks(df: DataFrame, name: str, n: int, *more: str) -> DataFrame:
    """Names packed into ``n`` blocks, a row each."""
    packed = df.groupBy(F.pmod(F.xxhash64(name), F.lit(n)).cast("int").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct(name, *more))).alias("rows"))
    packed = packed.select("blk", F.col(f"rows.{name}").alias("names"), *(F.col(f"rows.{c}").alias(c) for c in more))
    return materialize(packed, f"blocks-{name}")


#: Tasks of a round at most; adaptive execution would put the tiles, small in bytes, into few.
TASKS = 10000
NONE = {"vendor_norm": pa.array([], pa.string()), "supplier_norm": pa.array([], pa.string())}


def _tiles(v: DataFrame, packed: DataFrame, n: tuple[int, int], made: Callable, more: list) -> DataFrame:
    """The pairs that ``made`` gives of every tile: each of the ``n[0]`` blocks of vendors meets
    each of the ``n[1]`` packed blocks of suppliers once, by the tile's number."""
    across, side = n
    tasks = min(TASKS, across * side)
    left = _blocks(v, "vendor_norm", across, *more).select(
        "names", *more, F.col("blk").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("s"))
    right = packed.select("names", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("v"), F.col("blk").alias("s"))

    def pairs(vt: pa.Table, st: pa.Table) -> pa.Table:
        return made(vt, st) if vt.num_rows and st.num_rows else pa.table(NONE)

    left, right = (x.withColumn("tile", F.col("v") * F.lit(side) + F.col("s")).repartition(tasks, "tile") for x in (left, right))
    return left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(pairs, PAIRS)


def masked_pairs(vendors: DataFrame, suppliers: DataFrame, mask: Callable, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The (vendor_norm, supplier_norm) for which ``mask`` (two lists of names -> a matrix of
    booleans) is true, each once; pairs are never shuffled.  Names must be distinct and not null."""
    ship_code(vendors.sparkSession)
    v, s = vendors.select("vendor_norm"), suppliers.select("supplier_norm")
    n_v, n_s = sizes or (v.count(), s.count())
    across, side = max(1, -(-n_v // VENDORS)), max(1, -(-n_s // SUPPLIERS))

    def made(vt: pa.Table, st: pa.Table) -> pa.Table:
        a, b = vt.column("names")[0].as_py(), st.column("names")[0].as_py()
        i, j = np.nonzero(mask(a, b))
        return pa.table({"vendor_norm": pa.array(a, pa.string()).take(pa.array(i)),
                         "supplier_norm": pa.array(b, pa.string()).take(pa.array(j))})

    return _tiles(v, _blocks(s, "supplier_norm", side), (across, side), made, [])


def pairs_to_score(vendors: DataFrame, suppliers: DataFrame, bound: Callable, run: int = 3, least: int | None = None,
                   score: Callable[[DataFrame], DataFrame] | None = None, sizes: tuple[int, int] | None = None,
                   among: Callable | None = None) -> DataFrame:
    """The (vendor_norm, supplier_norm) among which every vendor's best partner is: those
    whose bound reaches ``least``, or, without it, the vendor's best of a first round that
    ``score`` (pairs -> vendor_norm, score) takes; all pairs of a vendor for which it leaves
    none.  Names must be distinct and not null; ``sizes``: their numbers, if known;
    ``among``: a mask (see ``masked_pairs``) outside of which no partner is searched."""
    ship_code(vendors.sparkSession)
    v, s = vendors.select("vendor_norm"), suppliers.select("supplier_norm")
    n_v, n_s = sizes or (v.count(), s.count())
    across, side = max(1, -(-n_v // VENDORS)), max(1, -(-n_s // SUPPLIERS))
    packed = _blocks(s, "supplier_norm", side)

    def tiles(v: DataFrame, first: int | None) -> DataFrame:
        made = _tiles(v, packed, (across, side), lambda vt, st: _tile(bound, run, first, vt, st, among), [] if first else ["least"])
        return materialize(made, "first-pairs" if first else "bounded-pairs")

    if least is not None:
        return tiles(v.withColumn("least", F.lit(least)), None)
    best = score(tiles(v, FIRST)).groupBy("vendor_norm").agg(F.max("score").alias("least"))
    return tiles(v.join(best, "vendor_norm", "left").select("vendor_norm", F.coalesce("least", F.lit(0)).alias("least")), None)
