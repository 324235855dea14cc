"""Connected components of a link table that may be of any size.

Alternating star contraction: "large star" links every larger neighbour of a node to the
smallest node around it, "small star" does so with the smaller neighbours.  Each round is
two grouped minima (partial per task) and two joins; hubs are joined as one row per link,
never gathered.  Rounds are written to the shared checkpoint folder, so lineage stays
short and a lost executor replays one round.  Only a row count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.session import materialize


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` has a > b.  Every b, and a itself, is linked to a's smallest b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    others = e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b (comparable ids of one type, in any order, repeats and loops
    allowed, rows with a null ignored).  Returns (node, root) for every node that has a
    link to another: root is the smallest node of its component."""
    e = materialize(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    last = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1000000007).cast("decimal(38,0)"))).first())
        if now == last or now[0] == 0:
            break
        last = now
        e = materialize(_small_star(_large_star(e)), "stars")
    # at the fixed point every node but the root has one link: to the root
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
