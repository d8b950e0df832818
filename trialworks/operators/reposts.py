"""Reposted stories: pairs with controls, audits, yield."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialworks.operators.effects import MOST_PAIRS
from trialworks.operators.ranks import median, within_budget
from trialworks.storage import written


def best_instance(stories: DataFrame) -> DataFrame:
    """Of identical titles of one link, the one with the most points, then the smaller id."""
    w = Window.partitionBy("url", "title").orderBy(F.desc("points"), "id")
    return stories.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repost_pairs(stories: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Distinct-title pairs of a link with what differs besides the title; a link with more than ``most`` is an error."""
    hour, day = (F.col("created_at_i") / 3600).cast("long") % 24, ((F.col("created_at_i") / 86400).cast("long") + 4) % 7
    d = within_budget(best_instance(stories), ["url"], most).withColumns({"log_score": F.ln(F.greatest("points", F.lit(1)).cast("double")), "hour": hour, "weekday": day})
    side = lambda a: d.select("url", *[F.col(c).alias(f"{c}_{a}") for c in ("id", "points", "author", "created_at_i", "log_score", "hour", "weekday")])
    p = side("a").join(side("b"), "url").where("id_a < id_b")
    return p.select("url", "id_a", "id_b", "points_a", "points_b", (F.col("log_score_a") - F.col("log_score_b")).alias("delta"), (F.abs(F.col("created_at_i_a") - F.col("created_at_i_b")) / 86400.0).alias("gap_days"),
                    (F.abs(F.col("hour_a") - F.col("hour_b")) <= 2).alias("same_hour"), (F.col("weekday_a") == F.col("weekday_b")).alias("same_weekday"), (F.col("author_a") == F.col("author_b")).alias("same_author"))


def confounding_audit(pairs: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    matched = F.col("same_hour") & F.col("same_weekday")
    size = F.abs("delta")
    pairs = written(pairs, "pairs")
    out = pairs.agg(F.count("*").alias("n_pairs"), F.lit(median(pairs, "gap_days")).cast("double").alias("median_gap"), F.avg("gap_days").alias("mean_gap"), share("same_hour").alias("same_hour"), share("same_weekday").alias("same_weekday"),
                    share("same_author").alias("same_author"), F.avg(F.when(matched, size)).alias("matched_size"), F.avg(F.when(~matched, size)).alias("other_size"))
    return out.withColumn("explained", 1 - F.col("matched_size") / F.nullif("other_size", F.lit(0.0)))


def lottery_audit(pairs: DataFrame, dead: int = 3, live: int = 20, hit: int = 50) -> DataFrame:
    lo, hi = F.least("points_a", "points_b"), F.greatest("points_a", "points_b")
    share = lambda c: F.avg(c.cast("double"))
    arms = pairs.select(F.explode(F.array("points_a", "points_b")).alias("p")).agg(share(F.col("p") <= dead).alias("dead_arms"))
    out = pairs.agg(share((lo <= dead) & (hi >= hit)).alias("flop_vs_hit"), share(hi <= dead).alias("both_dead"), share(lo >= live).alias("both_live"), F.avg(F.when(lo >= live, F.abs("delta"))).alias("live_size"), F.avg(F.abs("delta")).alias("all_size"))
    return out.crossJoin(arms)  # one row each


def repost_yield(stories: DataFrame) -> DataFrame:
    """One row: links, how many were posted twice, under two titles, with ten points, and the lead of a link's best post.

    The two best posts of a link come from counts per (link, points): the most points, and the most again where two posts have
    them, else the next value. No link's posts are gathered.
    """
    titles = stories.groupBy("url").agg(F.count("*").alias("posts"), F.count_distinct("title").alias("titles"))
    points = stories.where("points is not null").groupBy("url", "points").agg(F.count("*").alias("n"))
    best = points.groupBy("url").agg(F.max(F.struct("points", "n")).alias("top"))
    next_ = points.join(best, "url").where(F.col("points") < F.col("top.points")).groupBy("url").agg(F.max("points").alias("next"))
    g = titles.join(best, "url", "left").join(next_, "url", "left")
    second = F.when(F.col("top.n") > 1, F.col("top.points")).otherwise(F.col("next"))
    two = F.col("titles") >= 2
    g = written(g.select("posts", "titles", F.col("top.points").alias("best"), F.when(two, F.col("top.points") - second).alias("gap")), "links")
    middle = F.lit(median(g, "gap")).cast("double")
    return g.agg(F.count("*").alias("urls"), F.count_if(F.col("posts") >= 2).alias("reposted"), F.count_if(F.col("titles") >= 2).alias("retitled"), F.count_if(F.col("best") >= 10).alias("ten_points"), middle.alias("median_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
