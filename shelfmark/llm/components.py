"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link; component is the smallest id reachable.

    The number of rounds grows with the logarithm of a component's size. Minima
    are pre-aggregated before the shuffle, and joins with a hub's many links can
    be split, so one hub may hold any share of the links. Null ends are ignored,
    repeated links and loops do no harm; no links give no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(least.select("u", F.col("m").alias("v")).union(moved).distinct(), "links")
        inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        double = edges.groupBy("u").count().filter("count > 1").limit(1).count()
        if not inner and not double:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
