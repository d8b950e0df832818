"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialworks.storage import written


def _to_min(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point each neighbour of ``u`` at the least id around ``u``."""
    if larger_only:  # large star: every neighbour, re-pointed where it is larger than u
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # small star: edges run from the larger end to the smaller
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each id that an edge touches, the least id it can reach.

    Self-loops and edges with a null end are ignored; an empty table gives an empty result. Each round costs two
    shuffles of the shrinking edge table and is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain, not with its length.
    """
    ends = [F.col(src).alias("u"), F.col(dst).alias("v")]
    start = edges.select(*ends).where("u is not null and v is not null and u <> v")
    now = written(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = written(_to_min(_to_min(now, True), False), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
