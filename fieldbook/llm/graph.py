"""Connected components over DataFrames by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, of edges(u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
    large = both.select("u", "v", low.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # every edge now points from the larger to the smaller end
    least = F.min("v").over(Window.partitionBy("u"))
    small = large.select("u", "v", least.alias("m"))
    return small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) for every node of links(u, v); nodes without links are absent."""
    flat = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, before = cut(flat, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, old = now, edges
        edges = cut(_stars(edges), "links")
        drop_cut(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v"))).distinct()
