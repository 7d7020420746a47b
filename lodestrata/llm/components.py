"""Connected components by alternating large-star and small-star rounds over a table of links.

Each round is joins and aggregations only; nothing is collected but two sums that tell whether the
links still change. The number of rounds grows with the logarithm of the number of nodes.

Defined results: a link of a node to itself, or with a null node, is left out, as is a node that has no other;
repeated links and both directions of one count once; no links give no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage, release


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """u, root for each node of the links (columns a, b: any orderable type): root is the least node reachable."""
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(pairs)
    before = _state(e)
    while True:
        e, old = cut_lineage(_small_star(_large_star(e))), e
        release(old)
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return e.select("u", F.col("v").alias("root")).union(roots)
