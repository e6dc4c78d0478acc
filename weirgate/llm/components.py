"""Connected components by alternating large-star and small-star, in DataFrame expressions only.

Edges are rewritten until they form stars whose centre is the smallest node: large-star links the larger
neighbours of each node to its smallest neighbour, small-star its smaller ones. Both keep the components
and halve the distance to the smallest node, so a few rounds do. Minima are combined before the shuffle.
They are joined back to the edges by node; nodes with over a thousandth of the edges, a thousand at most, come by
a broadcast, and their edges are dealt by a salt. So a star of any size is spread over all tasks.
Each half of a round is written to the shared folder; only counts and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import discard, materialize


def _with_least(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """The edges with the m of the node in column `key`; least has a node's m, and in n how many edges have it there."""
    limit = max(1000, total // 1000)
    hot = least.where(F.col("n") > limit).select(F.col("node").alias("hot"), F.col("m").alias("hot_m"))
    marked = edges.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left")
    salt = F.when(F.col("hot").isNotNull(), 1 + F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).otherwise(F.lit(0).cast("long"))
    # not a literal, or the optimiser would take the salt out of the join's keys
    none = F.when(F.col("n") < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    joined = marked.withColumn("salt", salt).join(least.select("node", "m", none.alias("none")), (F.col(key) == F.col("node")) & (F.col("salt") == F.col("none")), "left")
    return joined.select("u", "v", F.coalesce("hot_m", "m").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """u is the larger node of each edge, before and after."""
    upper = F.struct(F.col("u").alias("node"), F.col("v").alias("m"), F.lit(0).alias("n"))
    lower = F.struct(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("m"), F.lit(1).alias("n"))
    ends = edges.select(F.explode(F.array(upper, lower)).alias("end")).select("end.*")
    least = ends.groupBy("node").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    return _with_least(edges, "v", least, total).select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, "u", least, total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its smallest node) of every node that has an edge to another; nulls and loops link nothing."""
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen, total = None, now.count()
    while True:
        wide = materialize(_large_star(now, total), "cc")
        nxt = materialize(_small_star(wide, total), "cc")
        stamp = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first())
        discard(now, wide)
        now, total = nxt, stamp[0]
        if stamp == seen or not total:
            break
        seen = stamp
    # every node but the centres points to its centre
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
