"""Connected components of links, as joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import kept


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (u, v of one type that can be ordered): root is the least node of its component.

    Every round hangs each node's greater neighbours on its least one, then its smaller ones, until nothing moves; depth falls
    by a power, so the rounds are few. A node with very many links is a key of a plain join, whose large partitions Spark can
    split, and of a minimum that is taken before rows move. Rounds are written to the shared folder. No link, no row; links of a
    node with itself, of null, and repeated ones add nothing."""
    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _size(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = kept(large, "large")  # at most as many rows as both; repeated ones go with the smaller neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = kept(small.distinct(), "small")
        after = _size(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
