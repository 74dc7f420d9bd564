"""Connected components of a graph of links, by alternating large and small stars on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm._shared import drop_tables, facts_join, table


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with the least of u and its v as m, and the table of these. Minima are taken map-side and written; few are broadcast, for more
    both sides of the join back have a shuffle of their own and AQE can split it at a node with many edges."""
    least = table(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return facts_join(edges, least, ["u"]), least


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of edges (u, v), all with u > v, has one v, which is no u itself: then v is the least node that u reaches."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root), written, for each node of links (u, v) that is not its own root: root is the least node reachable.
    Rounds: logarithmic in the nodes; none where the links are stars already."""
    now = table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(now):
        last = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows, least = _least(both)
        large = table(rows.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop_tables(least)
        stars, least = _least(large)
        now = table(stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_tables(least, large, last)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._work_path = vars(now)["_work_path"]  # for drop_tables()
    return out
