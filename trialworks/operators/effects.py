"""Experiment arms: validity, within-experiment effects, noise, decidability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.operators.ranks import median, values_at, within_budget
from trialworks.storage import written

#: Pairs of one experiment (or link) above which a pair builder fails instead of making them.
MOST_PAIRS = 50_000_000


def by(*cols: str):
    return Window.partitionBy(*cols)


def valid_arms(arms: DataFrame, min_impressions: int = 500) -> DataFrame:
    """Arms with copy, enough impressions and a possible number of clicks. Unparsable numbers fail."""
    n, c = F.col("impressions").try_cast("double").cast("long"), F.col("clicks").try_cast("double").cast("long")
    return arms.withColumns({"impressions": n, "clicks": c}).where(
        (F.length(F.trim("copy_text")) > 0) & (F.col("impressions") >= min_impressions) & F.col("clicks").between(0, F.col("impressions"))
    )


def min_arms(arms: DataFrame, k: int = 2) -> DataFrame:
    """Arms of experiments with at least k arms and some impressions and clicks; adds the totals."""
    w = by("test_id")
    sums = {"test_arms": F.count("*").over(w), "test_impressions": F.sum("impressions").over(w), "test_clicks": F.sum("clicks").over(w)}
    return arms.withColumns(sums).where((F.col("test_arms") >= k) & (F.col("test_impressions") > 0) & (F.col("test_clicks") > 0))


def within_test_contrast(arms: DataFrame) -> DataFrame:
    """Adds ctr, log_odds, target (log-odds less the experiment's pooled one) and weight (inverse variance).

    Takes the output of :func:`min_arms`, whose window by experiment this reuses without another shuffle.
    """
    lo = S.logit(S.smoothed_rate("clicks", "impressions"))
    pool = S.logit(S.smoothed_rate("test_clicks", "test_impressions"))
    return arms.withColumns({"ctr": F.col("clicks") / F.col("impressions"), "log_odds": lo, "target": lo - pool, "weight": 1 / S.log_odds_variance("clicks", "impressions")})


def labelled_arms(arms: DataFrame, min_impressions: int = 500, k: int = 2) -> DataFrame:
    return within_test_contrast(min_arms(valid_arms(arms, min_impressions), k))


def shrunk_target(arms: DataFrame) -> DataFrame:
    """Empirical Bayes: each target shrunk to its experiment's mean by the noise share of the variance."""
    w = by("test_id")
    var, mean = F.var_pop("target").over(w), F.avg("target").over(w)
    noise = F.avg(S.log_odds_variance("clicks", "impressions")).over(w)
    keep = F.greatest(F.lit(0.0), var - noise) / F.nullif(var, F.lit(0.0))
    return arms.withColumn("shrunk", F.when((F.count("*").over(w) < 2) | (var <= 0), F.col("target")).otherwise(mean + keep * (F.col("target") - mean)))


def shrunk_rates(arms: DataFrame, group: str = "test_id") -> DataFrame:
    """Click rates shrunk to the experiment's weighted mean by binomial noise, clipped to [1e-6, 1]."""
    w, rate = by(group), F.col("clicks") / F.col("impressions")
    mean = F.sum("clicks").over(w) / F.sum("impressions").over(w)
    noise, var = F.avg(rate * (1 - rate) / F.col("impressions")).over(w), F.var_pop(rate).over(w)
    keep = F.coalesce(F.greatest(F.lit(0.0), var - noise) / F.nullif(var, F.lit(0.0)), F.lit(0.0))
    return arms.withColumn("shrunk_rate", F.least(F.lit(1.0), F.greatest(F.lit(1e-6), mean + keep * (rate - mean))))


def pooled_target(arms: DataFrame) -> DataFrame:
    """Impression-weighted mean target of a copy over all experiments that ran it, for copies run more than once."""
    w = by("copy_text")
    out = arms.withColumns({"runs": F.count("*").over(w), "pooled": F.sum(F.col("target") * F.col("impressions")).over(w) / F.sum("impressions").over(w)})
    return out.where("runs > 1")


def variance_decomposition(arms: DataFrame) -> DataFrame:
    """One row: observed, noise and signal variance of the targets, and their signal-to-noise ratio."""
    out = arms.agg(F.var_pop("target").alias("observed"), (2 * F.avg(S.log_odds_variance("clicks", "impressions"))).alias("noise"))
    out = out.withColumn("signal", F.greatest(F.col("observed") - F.col("noise"), F.lit(1e-9)))
    return out.withColumn("snr", F.sqrt(F.col("signal")) / F.sqrt("noise"))


def corpus_profile(arms: DataFrame, min_impressions: int) -> DataFrame:
    """One row about a corpus: rows, drops by reason, experiment sizes, impressions and rates.

    Medians and the tenth (the value at a tenth of the rows, counted from 0) are exact, from counts in ranges of the value.
    """
    small, odd = F.col("impressions") < min_impressions, (F.col("clicks") < 0) | (F.col("clicks") > F.col("impressions"))
    ok = ~small & ~odd & (F.length(F.trim("copy_text")) > 0)
    rate = F.when(ok, F.col("clicks") / F.col("impressions"))
    n = F.when(ok, F.col("impressions"))
    one = arms.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("usable"), F.count_if(small).alias("too_small"), F.count_if(~small & odd).alias("odd_clicks"),
                   F.avg(rate).alias("mean_ctr"), F.max(rate).alias("max_ctr"), (F.count_if(ok) - F.count_distinct(F.when(ok, F.col("copy_text")))).alias("repeated_copies"))
    good = written(arms.where(ok).select("test_id", n.alias("n"), rate.alias("rate")), "usable")
    sizes = written(good.groupBy("test_id").agg(F.count("*").alias("k")), "sizes")
    tests = sizes.agg(F.count("*").alias("n_tests"), F.avg("k").alias("mean_arms"), F.max("k").alias("max_arms"))
    tenth = good.count() // 10
    found = {"median_impressions": median(good, "n"), "p10_impressions": values_at(good, "n", [tenth]).get(tenth), "median_ctr": median(good, "rate"), "median_arms": median(sizes, "k")}
    kinds = {"p10_impressions": "long"}
    return one.crossJoin(tests).withColumns({k: F.lit(v).cast(kinds.get(k, "double")) for k, v in found.items()})  # one row each


def release_totals(arms: DataFrame) -> DataFrame:
    return arms.rollup("release").agg(F.count("*").alias("n_rows"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.count_distinct("test_id").alias("n_tests"))


def ranked(df: DataFrame, score: str, key: str, group: str = "test_id") -> DataFrame:
    """Adds rank within the group, and margin: how far the score leads the next one (null for the last)."""
    w = by(group).orderBy(F.desc(score), key)
    return df.withColumns({"rank": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w)})


def decidability(arms: DataFrame) -> DataFrame:
    """Per experiment, its two best arms by rate: can the comparison be settled, and what would it take?"""
    rate = F.col("clicks") / F.greatest(F.col("impressions"), F.lit(1))
    w = by("test_id").orderBy(F.desc("rate"), "arm_id")
    top = arms.withColumn("rate", rate).withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    two = top.groupBy("test_id").agg(*[pick(r, c).alias(f"{c}_{r}") for r in (1, 2) for c in ("arm_id", "impressions", "clicks", "rate")]).where("arm_id_2 is not null")
    pooled = F.greatest((F.col("clicks_1") + F.col("clicks_2")) / F.greatest(F.col("impressions_1") + F.col("impressions_2"), F.lit(1)), F.lit(1e-6))
    least = F.least("impressions_1", "impressions_2")
    delta = S.logit(S.clamped(F.col("rate_1"))) - S.logit(S.clamped(F.col("rate_2")))
    out = two.select("test_id", F.col("arm_id_1").alias("best"), F.col("arm_id_2").alias("second"), delta.alias("observed_delta"), least.alias("min_impressions"),
                     S.local_ceiling(least, pooled).alias("ceiling"), S.required_impressions(delta, pooled).alias("needed"))
    out = out.withColumn("shortfall", F.greatest(F.lit(0.0), F.col("needed") - F.col("min_impressions")))
    return out.withColumn("decidable", F.coalesce(F.col("shortfall") == 0, F.lit(False)))


def build_pairs(arms: DataFrame, min_gap: float = 0.05, vector: str | None = None, most: int = MOST_PAIRS, scores: Sequence[str] = ()) -> DataFrame:
    """Winner and loser of every comparable pair of an experiment: target gap of at least ``min_gap``, different copy.

    ``vector`` names a feature array: pairs whose arrays are equal are left out, too. The number of pairs is the sum of
    squared experiment sizes by definition; an experiment with more than ``most`` is an error, and :func:`pair_budget`
    tells which. ``scores`` names columns that a pair takes along from both arms, as {name}_hi and {name}_lo: joined
    to the pairs afterwards (:func:`evaluate.score_pairs`), they would move all of them.
    """
    columns = ["arm_id", "copy_text", "target", "weight", *([vector] if vector else []), *scores]
    arms = within_budget(arms.select("test_id", *columns), ["test_id"], most)
    side = lambda a: arms.select("test_id", *[F.col(c).alias(f"{c}_{a}") for c in columns])
    both = side("a").join(side("b"), "test_id").where("arm_id_a < arm_id_b and copy_text_a <> copy_text_b")
    if vector:
        both = both.where(~F.col(f"{vector}_a").eqNullSafe(F.col(f"{vector}_b")))
    gap, first = F.abs(F.col("target_a") - F.col("target_b")), F.col("target_a") > F.col("target_b")
    pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    harmonic = 2 / (1 / F.col("weight_a") + 1 / F.col("weight_b"))
    taken = [pick(c, *sides).alias(f"{c}_{name}") for c in scores for name, sides in (("hi", "ab"), ("lo", "ba"))]
    return both.where(gap >= min_gap).select("test_id", pick("arm_id", "a", "b").alias("hi_id"), pick("arm_id", "b", "a").alias("lo_id"), gap.alias("gap"), harmonic.alias("pair_weight"), *taken)


def pair_budget(arms: DataFrame, limit: int) -> DataFrame:
    """Experiments whose pair count alone exceeds ``limit``: look at them before building pairs."""
    n = F.count("*")
    return arms.groupBy("test_id").agg((n * (n - 1) / 2).cast("long").alias("pairs")).where(F.col("pairs") > limit)


def image_controlled_pairs(arms: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Same-test pairs that share an image, by what differs: headline, only body, nothing; with |z| of the difference.

    More than ``most`` pairs of one experiment and image are an error."""
    arms = within_budget(arms.withColumn("image_id", F.coalesce("image_id", F.lit(""))), ["test_id", "image_id"], most)
    side = lambda a: arms.select("test_id", "image_id", *[F.col(c).alias(f"{c}_{a}") for c in ("arm_id", "copy_text", "lede", "impressions", "clicks")])
    p = side("a").join(side("b"), ["test_id", "image_id"]).where("arm_id_a < arm_id_b")
    cell = F.when(F.col("copy_text_a") != F.col("copy_text_b"), "headline").when(~F.col("lede_a").eqNullSafe(F.col("lede_b")), "body").otherwise("nothing")
    lo = lambda a: S.logit(S.smoothed_rate(f"clicks_{a}", f"impressions_{a}"))
    se = F.sqrt(S.log_odds_variance("clicks_a", "impressions_a") + S.log_odds_variance("clicks_b", "impressions_b"))
    return p.select("test_id", "arm_id_a", "arm_id_b", cell.alias("cell"), (F.abs(lo("a") - lo("b")) / se).alias("z"))


def listwise(arms: DataFrame, score: str, tau: float = 0.5) -> DataFrame:
    """Softmax of target / tau, log-softmax of the score, and the experiment's listwise loss, over distinct copies."""
    w = by("test_id")
    first = Window.partitionBy("test_id", "copy_text").orderBy("arm_id")
    d = arms.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("list_size", F.count("*").over(w)).where("list_size >= 2")
    top, best = F.max(F.col("target") / tau).over(w), F.max(score).over(w)
    e = F.exp(F.col("target") / tau - top)
    d = d.withColumns({"p": e / F.sum(e).over(w), "log_q": F.col(score) - best - F.ln(F.sum(F.exp(F.col(score) - best)).over(w))})
    return d.withColumn("loss", -F.sum(F.col("p") * F.col("log_q")).over(w))
