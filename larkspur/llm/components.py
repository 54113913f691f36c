"""Connected components of a link table, on the cluster.

Large-star and small-star steps shrink the table until every link leads to the smallest id of its component. Each step is
aggregates of minima and joins, so a hub is summed before the shuffle or split by the join, and nothing is collected. A round
is one job: it writes its table to the shared folder and takes the table's checksum on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, summed


def components(links: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id that has a link to another one; component is the smallest id reachable.

    links may hold repeated rows, both directions and links of an id to itself; rows with nulls are passed over. An
    empty table gives no rows. known: the result for other links, which are thereby part of these.
    """
    if known is not None:
        links, a, b = links.select(a, b).toDF("a", "b").union(known.select("id", "component")), "a", "b"
    u, v = F.col(a), F.col(b)
    edges, state = _round(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    while state["n"]:
        before, last = state, edges
        edges, state = _round(_small_star(_large_star(edges)))
        discard(last)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The table of a round, and its number of rows and checksums."""
    wide = lambda x: F.sum(x.cast("decimal(38,0)"))
    return summed(edges, n=F.count(F.lit(1)), s=wide(F.xxhash64("u", "v")), t=wide(F.xxhash64("v", "u")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of an id to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of an id, and the id, to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", "m")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
