"""Evaluation of rankers on pairs, clustered by experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialworks.operators.ranks import narrowed_quantiles


def score_pairs(pairs: DataFrame, scores: DataFrame, name: str = "score") -> DataFrame:
    """Attaches both arms' scores as {name}_hi and {name}_lo. ``scores``: test_id, arm_id, name."""
    hi = scores.select("test_id", F.col("arm_id").alias("hi_id"), F.col(name).alias(f"{name}_hi"))
    lo = scores.select("test_id", F.col("arm_id").alias("lo_id"), F.col(name).alias(f"{name}_lo"))
    return pairs.join(hi, ["test_id", "hi_id"]).join(lo, ["test_id", "lo_id"])


def win(name: str = "score") -> Column:
    """1 for the right order, one half for a tie, 0 otherwise."""
    a, b = F.col(f"{name}_hi"), F.col(f"{name}_lo")
    return F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)


def margin(name: str = "score") -> Column:
    return F.abs(F.col(f"{name}_hi") - F.col(f"{name}_lo"))


def pairwise_accuracy(pairs: DataFrame, name: str = "score") -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(win(name)), F.lit(0.5)).alias("accuracy"), F.count("*").alias("n_pairs"))


def clustered_accuracy(pairs: DataFrame, name: str = "score") -> DataFrame:
    """Mean over experiments of their accuracy, with a 95 % interval over experiments."""
    return mean_interval(pairs.groupBy("test_id").agg(F.avg(win(name)).alias("x")), "x").withColumnRenamed("mean", "accuracy")


def mean_interval(df: DataFrame, x: str) -> DataFrame:
    out = df.agg(F.avg(x).alias("mean"), F.count(x).alias("n"), F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0)).alias("se"))
    return out.withColumns({"lo": F.col("mean") - 1.96 * F.col("se"), "hi": F.col("mean") + 1.96 * F.col("se")})


def strict_accuracy(pairs: DataFrame, name: str = "score", min_gap: float = 0.10) -> DataFrame:
    """Predicted ties are skipped, small true gaps left out."""
    kept = pairs.where((F.col("gap") >= min_gap) & (F.col(f"{name}_hi") != F.col(f"{name}_lo")))
    return kept.agg(F.coalesce(F.avg(win(name)), F.lit(0.5)).alias("accuracy"), F.count("*").alias("n_pairs"))


def accuracy_at_coverage(pairs: DataFrame, coverages: list[float], name: str = "score") -> DataFrame:
    """Clustered accuracy when only the most confident share of pairs is answered; one row per coverage.

    Thresholds are exact linear quantiles of the margins. The pairs are neither moved nor written but made again on each
    pass, so they should be cheap to make: from written arms, with the scores taken along (:func:`effects.build_pairs`).
    """
    p = pairs.select("test_id", margin(name).alias("m"), win(name).alias("w"))
    cuts = [0.0 if c >= 1.0 else cut for c, cut in zip(coverages, narrowed_quantiles(p, "m", [1.0 - c for c in coverages]))]
    kept = [F.col("m") >= F.lit(cut).cast("double") for cut in cuts]
    per = p.groupBy("test_id").agg(F.count("*").alias("all"), *[c for i, k in enumerate(kept) for c in (F.avg(F.when(k, F.col("w"))).alias(f"x{i}"), F.count_if(k).alias(f"k{i}"))])
    steps = F.array(*[F.struct(F.lit(float(c)).alias("target"), F.lit(cut).cast("double").alias("threshold"), F.col(f"x{i}").alias("x"), F.col(f"k{i}").alias("k")) for i, (c, cut) in enumerate(zip(coverages, cuts))])
    steps = per.select("all", F.explode(steps).alias("s")).select("all", "s.*")
    out = steps.groupBy("target", "threshold").agg(F.sum("all").alias("n_all"), F.avg("x").alias("accuracy"), F.sum("k").alias("n_pairs"), F.coalesce(F.stddev_samp("x") / F.sqrt(F.count("x")), F.lit(0.0)).alias("se")).where("n_pairs > 0")
    return out.select("target", "threshold", (F.col("n_pairs") / F.col("n_all")).alias("coverage"), "accuracy", (F.col("accuracy") - 1.96 * F.col("se")).alias("lo"), (F.col("accuracy") + 1.96 * F.col("se")).alias("hi"), "n_pairs")


def score_health(pairs: DataFrame, name: str = "score") -> DataFrame:
    a, b = F.col(f"{name}_hi"), F.col(f"{name}_lo")
    return pairs.agg(F.avg(a - b).alias("mean_lead"), F.stddev_pop(a - b).alias("sd_lead"), F.count_if(a > b).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(a < b).alias("losses"), F.avg(win(name)).alias("tie_corrected"))


def paired_diff(pairs: DataFrame, a: str, b: str, threshold: float = 0.0) -> DataFrame:
    """Difference of two models' accuracy over the experiments both scored: interval, win shares, keep or not."""
    per = pairs.groupBy("test_id").agg((F.avg(win(a)) - F.avg(win(b))).alias("d"))
    out = per.agg(F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"), F.avg((F.col("d") > 0).cast("double")).alias("win_share"),
                  F.avg((F.col("d") == 0).cast("double")).alias("tie_share"), F.avg((F.col("d") < 0).cast("double")).alias("loss_share"), F.count("*").alias("n"))
    return out.withColumn("lo", F.col("mean") - 1.96 * F.col("se")).withColumn("hi", F.col("mean") + 1.96 * F.col("se")).withColumn("keep", F.col("lo") > threshold)


def quadrants(pairs: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(f"{a}_hi") > F.col(f"{a}_lo"), F.col(f"{b}_hi") > F.col(f"{b}_lo")
    return pairs.agg(F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))


def top_disagreements(pairs: DataFrame, a: str, b: str, k: int = 25) -> DataFrame:
    """The k pairs that a orders right, b wrong, and by the widest difference of margins."""
    lead = lambda n: F.col(f"{n}_hi") - F.col(f"{n}_lo")
    wrong = pairs.where((lead(a) > 0) & (lead(b) < 0)).withColumn("difference", F.round(lead(a) - lead(b), 9))
    return wrong.orderBy(F.desc("difference"), "test_id", "hi_id", "lo_id").limit(k).select("test_id", "hi_id", "lo_id", "difference")


def flip_rate(pairs: DataFrame, base: str, alt: str) -> DataFrame:
    """One row: share of pairs whose order changes, mean and largest size of what a score lead changes by."""
    lead = lambda n: F.col(f"{n}_hi") - F.col(f"{n}_lo")
    return pairs.agg(F.avg((F.signum(lead(base)) != F.signum(lead(alt))).cast("double")).alias("flip_rate"), F.avg(F.abs(lead(base) - lead(alt))).alias("mean_change"), F.max(F.abs(lead(base) - lead(alt))).alias("max_change"))
