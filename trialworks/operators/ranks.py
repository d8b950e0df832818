"""Values at ranks of a whole column, exact, without one task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialworks.operators.prefix import sum_before
from trialworks.storage import unused, written


def counted_ranges(values: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(v, n, at) of a column's different values, and how many values there are: ``at`` values are smaller. Nulls are none.

    Counts per value are made before the shuffle, dealt out in ranges of the value and summed range by range.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id().cast("long")), "values")
    total = counts.agg(F.sum("n")).first()[0] or 0
    first = sum_before(counts.groupBy("range").agg(F.sum("n").alias("n")), [], "range", "n", "first").select("range", "first")
    w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(first, "range").select("v", "n", (F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("at")), total


def values_at(values: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks, from 0 in rising order; ranks that do not exist are left out. A number a rank comes back."""
    ranges, total = counted_ranges(values, column)
    wanted = sorted({r for r in ranks if 0 <= r < total})
    if not wanted:
        return {}
    hits = F.filter(F.array(*[F.lit(r).cast("long") for r in wanted]), lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("n")))
    return {r.rank: r.v for r in ranges.select("v", F.explode(hits).alias("rank")).collect()}


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, linear between two ranks; None of an empty column."""
    ranges, total = counted_ranges(values, column)
    if not total:
        return [None] * len(shares)
    spots = [s * (total - 1) for s in shares]
    wanted = sorted({r for p in spots for r in (math.floor(p), math.ceil(p))})
    hits = F.filter(F.array(*[F.lit(r).cast("long") for r in wanted]), lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("n")))
    return _between({r.rank: float(r.v) for r in ranges.select("v", F.explode(hits).alias("rank")).collect()}, spots)


def _between(v: dict[int, float], spots: list[float]) -> list[float]:
    """Values at places between ranks, linear, from those at the ranks."""
    return [v[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * v[math.floor(p)] + (p - math.floor(p)) * v[math.ceil(p)] for p in spots]


def narrowed_quantiles(values: DataFrame, column: str, shares: list[float], bins: int = 65_536) -> list[float | None]:
    """What :func:`quantiles` gives for doubles that are cheap to make anew and too many to move.

    The rows are made three times and none is written: for the column's ends, for counts in ``bins`` equal parts between
    them, and for the values of the parts that hold a wanted rank, which alone are ranked.
    """
    total, least, most = values.agg(F.count(column), F.min(column), F.max(column)).first()
    if not total:
        return [None] * len(shares)
    if not math.isfinite(most - least) or not math.isfinite(bins / (most - least) if most > least else 0.0):
        return quantiles(values, column, shares)
    spots = [s * (total - 1) for s in shares]
    wanted = sorted({r for p in spots for r in (math.floor(p), math.ceil(p))})
    part = F.floor((F.col(column) - F.lit(float(least))) * F.lit(bins / (most - least) if most > least else 0.0))  # rises with the value
    counts = values.where(F.col(column).isNotNull()).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row a part
    before, kept, ranks, below = 0, [], {}, 0
    for p, n in sorted((r.part, r.n) for r in counts):
        here = [r for r in wanted if before <= r < before + n]
        ranks |= {r: r - below for r in here}  # among the values of the kept parts
        if here:
            kept.append(p)
        else:
            below += n
        before += n
    found = values_at(values.where(part.isin(kept)), column, list(ranks.values()))
    return _between({r: float(found[at]) for r, at in ranks.items()}, spots)


def median(values: DataFrame, column: str) -> float | None:
    return quantiles(values, column, [0.5])[0]


def within_budget(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows, or an error where the pairs of one key's rows are more than ``most``: look at that key first.

    The count is a window over the keys, by which a join for the pairs deals the rows anyway.
    """
    n = unused(rows, "__n")
    over = F.col(n) * (F.col(n) - 1) / 2 > most
    what = F.concat(F.lit("too many pairs for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    rows = rows.withColumn(n, F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.when(over, F.raise_error(what).cast("boolean")).otherwise(F.lit(True))).drop(n)
