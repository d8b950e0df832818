"""Checks that a fit has learnt something: shuffled labels, baselines, learning curves, and how far replication can agree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.operators.effects import MOST_PAIRS, shrunk_rates
from trialworks.operators.ranks import within_budget


def ridge_by_variant(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0) -> DataFrame:
    """(variant, train_r2, val_r2) of a ridge fit per variant. ``rows`` has variant and fit, which marks the rows to fit on.

    All variants are fitted by one aggregate and scored by another; only a small matrix per variant is solved here. R2 is
    against the mean of the rows scored; it is null where they do not vary.
    """
    n = len(features)
    sums = rows.where("fit").groupBy("variant").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features[: i + 1])],
                                                    *[F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(features)])
    weights = []
    for r in sums.collect():  # a row per variant
        gram = np.array([[r[f"x{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float) + penalty * np.eye(n)
        weights.append((r.variant, [float(w) for w in np.linalg.solve(gram, np.array([r[f"y{i}"] or 0.0 for i in range(n)], float))]))
    w = rows.sparkSession.createDataFrame(weights, "variant string, w array<double>")
    predicted = sum((F.col(f) * F.col("w")[i] for i, f in enumerate(features)), F.lit(0.0))
    return r2_by_variant(rows.join(F.broadcast(w), "variant").withColumn("predicted", predicted), y)  # a row per variant


def r2_by_variant(rows: DataFrame, y: str) -> DataFrame:
    """(variant, train_r2, val_r2) of the column ``predicted``."""
    def r2(cond: Column) -> Column:
        of = F.when(cond, F.col(y))
        return 1 - F.avg(F.when(cond, (F.col(y) - F.col("predicted")) * (F.col(y) - F.col("predicted")))) / F.nullif(F.var_pop(of), F.lit(0.0))

    return rows.groupBy("variant").agg(r2(F.col("fit")).alias("train_r2"), r2(~F.col("fit")).alias("val_r2"))


def label_permutation_control(rows: DataFrame, features: list[str], y: str, group: str, key: Column, repeats: int = 3, tolerance: float = 0.0) -> DataFrame:
    """(variant, train_r2, val_r2, passed): the fit, and fits after the labels to fit on were dealt anew within their group
    in hash order. The real fit passes if it exceeds every shuffled one by more than ``tolerance``. Keys must be distinct."""
    real = rows.withColumn("key", key)
    made = real.select("*", F.lit("real").alias("variant"))
    train = real.where("fit")
    for r in range(repeats):
        at = train.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy("key")))
        dealt = train.select(group, F.col(y).alias("dealt"), F.row_number().over(Window.partitionBy(group).orderBy(S.hash01("key", 40 + r), "key")).alias("at"))
        shuffled = at.join(dealt, [group, "at"]).withColumn(y, F.col("dealt"))
        name = f"shuffled {r + 1}"
        made = made.unionByName(shuffled.select(*real.columns, F.lit(name).alias("variant"))).unionByName(real.where("not fit").select("*", F.lit(name).alias("variant")))
    out = ridge_by_variant(made, features, y)
    top = out.agg(F.max(F.when(F.col("variant") != "real", F.col("val_r2"))).alias("top"))
    return out.crossJoin(F.broadcast(top)).select("variant", "train_r2", "val_r2", F.when(F.col("variant") == "real", F.col("val_r2") > F.col("top") + tolerance).alias("passed"))  # one row on the right


def baseline_floor(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """(variant, train_r2, val_r2) of what a model must beat: the mean of the rows to fit on, and a ridge fit."""
    mean = rows.where("fit").agg(F.avg(y).alias("predicted"))
    flat = r2_by_variant(rows.crossJoin(F.broadcast(mean)).withColumn("variant", F.lit("mean")), y)  # one row on the right
    return flat.unionByName(ridge_by_variant(rows.withColumn("variant", F.lit("ridge")), features, y))


def learning_curve(rows: DataFrame, features: list[str], y: str, key: Column, shares: tuple[float, ...] = (0.25, 0.5, 1.0), most: float = 0.25) -> DataFrame:
    """(variant, train_r2, val_r2, sound): fits on nested shares of the rows to fit on, by hash; a variant is sound if its
    training and validation values differ by less than ``most``."""
    made = rows.withColumn("at", S.hash01(key, 50)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    made = made.where(~F.col("fit") | (F.col("at") < F.col("share"))).withColumn("variant", F.col("share").cast("string"))
    return ridge_by_variant(made, features, y).withColumn("sound", F.col("train_r2") - F.col("val_r2") < most)


def replication_ceiling(arms: DataFrame, gaps: list[float], replicates: int = 4, group: str = "test_id", arm: str = "arm_id", shrink: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """(gap, ceiling, pairs): how often two replications of an experiment agree on the order of two arms, among the pairs
    that the second sets at least ``gap`` apart; the mean over ``replicates`` and the pairs of the last one.

    A replication draws an arm's clicks from a normal of the binomial's mean and variance, from hashed numbers. With
    ``shrink`` its rate is not the observed one but that shrunk to the experiment's mean by the noise share of the spread.
    More than ``most`` pairs of an experiment are an error.
    """
    arms = within_budget(arms, [group], most)
    key = F.concat_ws("/", F.col(group).cast("string"), F.col(arm).cast("string"), F.col("rep").cast("string"))
    n, p = F.col("impressions"), F.col("clicks") / F.col("impressions")
    if shrink:
        arms, p = shrunk_rates(arms, group), F.col("shrunk_rate")

    def log_odds(seed: int) -> Column:
        u = F.sqrt(-2 * F.ln(F.greatest(S.hash01(key, seed), F.lit(1e-12)))) * F.cos(2 * math.pi * S.hash01(key, seed + 1))
        c = F.floor(F.least(n.cast("double"), F.greatest(F.lit(0.0), n * p + F.sqrt(n * p * (1 - p)) * u)) + 0.5)
        return F.ln((c + 0.5) / (n - c + 0.5))

    drawn = arms.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(F.col(group), F.col(arm), "rep", log_odds(60).alias("one"), log_odds(62).alias("two"))
    a, b = drawn.alias("a"), drawn.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.rep") == F.col("b.rep")) & (F.col(f"a.{arm}") < F.col(f"b.{arm}")))
    pairs = pairs.select("a.rep", (F.col("a.one") - F.col("b.one")).alias("one"), (F.col("a.two") - F.col("b.two")).alias("two")).where("one <> 0")
    per = pairs.select("*", F.explode(F.array(*[F.lit(g) for g in gaps])).alias("gap")).where(F.abs("two") >= F.col("gap"))
    per = per.groupBy("gap", "rep").agg(F.avg(((F.col("one") > 0) == (F.col("two") > 0)).cast("double")).alias("agree"), F.count("*").alias("n"))
    return per.groupBy("gap").agg(F.avg("agree").alias("ceiling"), F.max(F.when(F.col("rep") == replicates, F.col("n"))).alias("pairs"))
