"""Embedding near-duplicates with a pivot-permutation index.

Pivots (reference points) are chosen from a bounded sample of the vectors: at most
``4 * most_pivots`` vectors by a hash, of which those are kept that are not alike
(cosine below ``APART``), about ``2 * sqrt(n)`` and at most ``most_pivots``.  Every vector
is described by the ordered list of its ``nearest`` nearest pivots.  Inverted lists hold,
for each label and pivot, the vectors that have the pivot in their list.  Two vectors are
candidates if they share at least ``shared`` pivots, or every pivot where a dimension has
fewer (vectors that all point one way leave one pivot); a candidate pair is linked if its
cosine, in double precision, reaches ``least``.

Equal vectors of a label are one entry with its number of copies, so copies are never
compared with each other.  A list is worked through in blocks: a list longer than
``block`` is cut into chunks by hash, and every pair of chunks is a group of its own, so
that no task holds a long list.  Inside a group numpy counts shared pivots and links; a
pair that meets in several lists counts in the list of its first shared pivot only.  A
group returns, for each entry, the number of its links and one star link to the smallest
entry it is connected with there: rows in proportion to entries, not to pairs.

Defined results: a vector that is null or zero, or holds null or non-finite components, or
whose label or id is null, links with nothing (n_links 0, its own component); vectors of
different lengths do not link; rows of one id and label and equal vectors are copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgermatch.llm.common import ship
from ledgermatch.llm.components import components
from ledgermatch.session import materialize

LEAST = 0.93
NEAREST = 10
SHARED = 2
MOST_PIVOTS = 2048
APART = 0.8
BLOCK = 2048


def choose_pivots(entries: DataFrame, most_pivots: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, from a bounded sample by hash."""
    out = {}
    for r in entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        n, dim = r["n"], r["dim"]
        want = int(min(most_pivots, max(32, 2 * n ** 0.5)))
        share = min(1.0, 4 * want / n)
        spot = F.pmod(F.col("k2"), F.lit(1 << 30))
        rows = (entries.where((F.col("dim") == dim) & (spot < int(share * (1 << 30)) + 1))
                .orderBy("k2").select("embedding").limit(6 * want).collect())
        x = np.array([v["embedding"] for v in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        kept = np.empty((0, dim))
        for v in x:
            if len(kept) < want and (not len(kept) or (kept @ v).max() < APART):
                kept = np.vstack([kept, v])
        out[dim] = kept
    return out


def permutations(pivots: dict[int, np.ndarray], nearest: int = NEAREST):
    """Column function: vector -> its nearest pivots, the nearest first."""
    ship()
    packed = {d: p.astype(np.float32) for d, p in pivots.items()}

    @pandas_udf("array<int>")
    def nearest_pivots(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        dims = v.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            p = packed[int(d)]
            near = np.stack(v.to_numpy()[at]).astype(np.float32) @ p.T
            k = min(nearest, len(p))
            part = np.argpartition(-near, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
            for i, row in zip(at, order):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    return nearest_pivots


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each index is connected with."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        now = np.minimum(root, least)
        if (now == root).all():
            return root
        root = now


def links_of_group(group: pd.DataFrame, least: float, shared: int) -> pd.DataFrame:
    """Links among the entries of one inverted list (or of one pair of its chunks)."""
    pivot, i, j = int(group["pivot"].iat[0]), int(group["i"].iat[0]), int(group["j"].iat[0])
    g = group.sort_values("rep", kind="stable")
    lists = np.stack(g["nearest"].to_numpy())
    ids, at = np.unique(lists, return_inverse=True)
    has = np.zeros((len(g), len(ids)), np.float32)
    has[np.repeat(np.arange(len(g)), lists.shape[1]), at.ravel()] = 1
    lower = has[:, ids < pivot]
    linked = (has @ has.T >= min(shared, lists.shape[1])) & (lower @ lower.T == 0)  # candidates of this list
    np.fill_diagonal(linked, False)
    chunk = g["chunk"].to_numpy()
    if i != j:
        linked &= chunk[:, None] != chunk[None, :]
    some = linked.any(axis=1)
    g, linked = g[some], linked[some][:, some]
    if not len(g):
        return pd.DataFrame({"rep": [], "links": [], "root": []})
    x = np.stack(g["embedding"].to_numpy()).astype(float)
    norm = np.linalg.norm(x, axis=1)
    linked &= (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
    rep = g["rep"].to_numpy()
    found = pd.DataFrame({"rep": rep, "links": linked @ g["copies"].to_numpy(), "root": rep[_local_roots(linked)]})
    return found[linked.any(axis=1)]


def entries_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, embedding and, for rows that can link, the two hashes of their entry."""
    v = F.col(vec_col)
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
            & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
            & F.exists(v, lambda x: x != 0))
    return vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("embedding"),
        F.when(fine, F.xxhash64(label_col, vec_col)).alias("k1"), F.when(fine, F.xxhash64(F.lit(7), vec_col, label_col)).alias("k2"))


def near_vectors(vectors: DataFrame, least: float = LEAST, nearest: int = NEAREST, shared: int = SHARED,
                 most_pivots: int = MOST_PIVOTS, block: int = BLOCK, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept."""
    rows = entries_of(vectors, id_col, vec_col, label_col)
    entries = materialize(
        rows.where("k1 is not null").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    near = permutations(choose_pivots(entries, most_pivots), nearest)
    lists = materialize(entries.withColumn("nearest", near("embedding")).select(
        "label", "dim", "rep", "copies", "embedding", "nearest", F.explode("nearest").alias("pivot")), "pivot-lists")
    chunks = lists.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    cut = lists.join(chunks, ["label", "dim", "pivot"]).withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # every pair (i <= j) of chunks that holds the row's own
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = met.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return links_of_group(group, least, shared)

    found = materialize(met.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(
        run, "rep bigint, links bigint, root bigint"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (entries.select("k1", "k2", "rep", "copies").join(counts, "rep", "left")
             .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "rep").alias("component_id")))
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
