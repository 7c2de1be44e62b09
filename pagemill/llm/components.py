"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import last_stored, mark, release
from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
    return both.withColumn("m", least).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # a > b in every edge that a large-star step leaves
    led = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return led.select("a", F.col("m").alias("b")).unionByName(led.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) of longs touches; the component's name is its smallest node."""
    since = mark()
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(found):
            break
        seen = tuple(found)
        now = stored(_small_star(_large_star(now).distinct()).distinct())
        release(edges.sparkSession, since, keep=(last_stored(),))  # the round before is read no more
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
