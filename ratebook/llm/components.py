"""Connected components of a graph of any size, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.operators.staging import stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Each vertex links its larger (``both``) or smaller neighbours to the least of all."""
    if both:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = near.join(least, "u")
    moved = met.where(F.col("v") > F.col("u")) if both else met
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v): every vertex that is not the least of its component, and that least one.

    ``edges`` has two long columns u and v, in any order, with repeats and loops. No
    vertex's neighbours are gathered: a round groups for minima and joins them back.
    """
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        now = stage(_star(_star(now, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
