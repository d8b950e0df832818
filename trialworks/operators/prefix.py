"""Running sums over a long order without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sum_before(df: DataFrame, by: list[str], order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the same ``by`` whose integer ``order`` is smaller.

    Rows must have distinct (by, order). Runs of ``block`` consecutive orders are summed first, so a task sorts one
    run, and only one row per run meets in the second sum.
    """
    d = df.withColumn("__run", F.floor(F.col(order) / block))
    runs = d.groupBy(*by, "__run").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*by, "__run", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return d.join(runs, [*by, "__run"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__run", "__base", "__in")
