"""Scoring and serving: request checks, guarded rankings, traffic allocation, ridge fits, nearest centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.functions import text as X
from trialworks.functions.hashing import hash01_draws
from trialworks.storage import written


def validate_request(variants: Column) -> Column:
    """The first rule that a request's variants break, or null: 2 to 8 of them, none blank, none over 5000 characters."""
    blank = F.exists(variants, lambda v: v.isNull() | (F.trim(v) == ""))
    return (
        F.when(F.coalesce(F.size(variants), F.lit(0)) < 2, "too few variants").when(F.size(variants) > 8, "too many variants")
        .when(blank, "blank variant").when(F.exists(variants, lambda v: F.length(v) > 5000), "variant too long")
    )


def guard_ranking(ranked: DataFrame, text: str, group: str = "test_id") -> DataFrame:
    """(group, caution): whether the variant of rank 1 carries more surface risk than every other. Order is never changed."""
    s = ranked.select(group, "rank", X.max_severity(X.guardrails(F.col(text))).alias("severity"))
    top, rest = F.max(F.when(F.col("rank") == 1, F.col("severity"))), F.max(F.when(F.col("rank") > 1, F.col("severity")))
    return s.groupBy(group).agg(top.alias("top"), rest.alias("rest")).select(group, ((F.col("top") > 0) & (F.col("top") > F.coalesce("rest", F.lit(-1.0)))).alias("caution"))


def verdict_band(score: Column, lo: float, hi: float) -> Column:
    return F.when(score < lo, "low").when(score > hi, "high").otherwise("optimal")


def profile_warnings(coverage: Column, words: Column, caps: Column) -> Column:
    """array<string>: what makes a profile unsure."""
    return F.array_compact(F.array(F.when(coverage < 0.4, "few rated words"), F.when(words < 4, "very short"), F.when((caps > 0.5) & (words > 3), "mostly capitals")))


def apply_scaler(df: DataFrame, features: list[str], fit: Column) -> DataFrame:
    """Features less their mean over their spread, both from the rows where ``fit`` holds; a spread near 0 counts as 1."""
    stats = df.where(fit).agg(*[F.avg(f).alias(f"{f}_mean") for f in features], *[F.stddev_pop(f).alias(f"{f}_sd") for f in features])
    sd = lambda f: F.when(F.col(f"{f}_sd") < 1e-6, 1.0).otherwise(F.col(f"{f}_sd"))
    scaled = {f: (F.col(f) - F.col(f"{f}_mean")) / sd(f) for f in features}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)  # one row on the right


def interaction(a: Column, b: Column) -> Column:
    """[a, b, a - b, a * b] of two vectors, as one."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: x * y))


def ridge(df: DataFrame, features: list[str], y: str, penalty: float = 1.0) -> np.ndarray:
    """Weights of (X'X + penalty) w = X'y: the sums are one distributed aggregate, only their small matrix is solved here."""
    n = len(features)
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features[: i + 1])], *[F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(features)]).first()
    gram = np.array([[sums[f"x{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float)
    return np.linalg.solve(gram + penalty * np.eye(n), np.array([sums[f"y{i}"] or 0.0 for i in range(n)], float))


def allocate(arms: DataFrame, draws: int = 2000, strength: float = 40.0, base: float = 0.0125, score: str | None = None, part: int = 4096) -> DataFrame:
    """(test_id, arm_id, share): how often an arm has the best rate over draws from its posterior.

    Rates start from ``base``, tilted by the softmax of the arms' standardised scores where ``score`` names a column, and
    weigh as ``strength`` impressions. A draw is a normal one with the posterior's mean and variance, from hashed numbers.

    Draws are made where an experiment's arms lie, ``part`` arms of it at most a group, and only the winners leave: as
    counts, or a winner a draw where an experiment has several groups.
    """
    w = Window.partitionBy("test_id")
    rate = F.lit(base)
    a = arms
    if score:
        sd = F.stddev_pop(score).over(w)
        a = a.withColumn("e", F.exp((F.col(score) - F.avg(score).over(w)) / F.when(sd > 0, sd).otherwise(1.0)))
        share = F.col("e") / F.sum("e").over(w) * F.count("*").over(w)
        rate = F.least(F.lit(0.5), F.greatest(F.lit(1e-4), base * (1 + 0.5 * (share - 1))))
    a = a.withColumn("rate", rate).select("test_id", "arm_id", (F.col("rate") * strength + F.col("clicks")).alias("alpha"), ((1 - F.col("rate")) * strength + F.col("impressions") - F.col("clicks")).alias("beta"))
    n = F.col("alpha") + F.col("beta")
    a = a.select("test_id", "arm_id", (F.col("alpha") / n).alias("mean"), F.sqrt(F.col("alpha") * F.col("beta") / (n * n * (n + 1))).alias("sd"))
    a = written(a, "posteriors")
    key = F.concat_ws("/", F.col("test_id").cast("string"), F.col("arm_id").cast("string")).cast("binary")
    d = a.select("test_id", "arm_id", key.alias("key"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "sd")], F.ceil(F.count("*").over(w) / part).alias("parts"))
    d = d.withColumn("part", F.pmod(F.xxhash64("arm_id"), F.col("parts")))
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work is in the draws, not in the rows
    d = d.repartition(tasks, "test_id", "part").sortWithinPartitions("test_id", "part", F.desc("arm_id"))  # of equal draws the larger id wins

    def winners(batches):
        import pyarrow as pa

        names, at_once, group, best = ["test_id", "arm_id", "draw", "value", "wins"], max(1, 1_000_000 // draws), None, None
        none = lambda n, kind: pa.nulls(n, kind)

        def done():
            test, parts, value, arm = best
            if parts == 1:
                of: dict = {}
                for x in arm:
                    of[x] = of.get(x, 0) + 1
                n = len(of)
                return [[test] * n, list(of), none(n, pa.int32()), none(n, pa.float64()), pa.array(of.values(), pa.int64())]
            return [[test] * draws, list(arm), pa.array(range(draws), pa.int32()), pa.array(value), none(draws, pa.int64())]

        def packed(found):
            cols = list(zip(*found))
            flat = [pa.array([x for c in cols[i] for x in c], kinds[i]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*flat, *[pa.concat_arrays(c) for c in cols[2:]]], names)

        for whole in batches:
            kinds = [whole.schema.field(n).type for n in names[:2]]
            for b in (whole.slice(i, at_once) for i in range(0, whole.num_rows, at_once)):
                keys, found = b.column("key").to_pylist(), []
                u = np.sqrt(-2 * np.log(np.maximum(hash01_draws(keys, draws, 21), 1e-12))) * np.cos(2 * np.pi * hash01_draws(keys, draws, 22))
                value = b.column("mean").to_numpy()[:, None] + b.column("sd").to_numpy()[:, None] * u
                value = np.round(np.where(np.isnan(value), 1.0, np.clip(value, 0.0, 1.0)), 12)
                arms = np.array(b.column("arm_id").to_pylist() + [None], object)[:-1]
                groups, parts = list(zip(b.column("test_id").to_pylist(), b.column("part").to_pylist())), b.column("parts").to_pylist()
                starts = [i for i in range(len(groups)) if not i or groups[i] != groups[i - 1]]
                for i, j in zip(starts, [*starts[1:], len(groups)]):
                    top = value[i:j].argmax(0)
                    high, arm = value[i:j][top, np.arange(draws)], arms[i:j][top]
                    if best is not None and groups[i] == group:
                        more = high > best[2]
                        high, arm = np.where(more, high, best[2]), np.where(more, arm, best[3])
                    elif best is not None:
                        found.append(done())
                    group, best = groups[i], (groups[i][0], parts[i], high, arm)
                if found:
                    yield packed(found)
        if best is not None:
            yield packed([done()])

    kind = {f.name: f.dataType.simpleString() for f in a.schema}
    won = written(d.mapInArrow(winners, f"test_id {kind['test_id']}, arm_id {kind['arm_id']}, draw int, value double, wins long"), "winners")
    best = won.where("draw is not null").groupBy("test_id", "draw").agg(F.max(F.struct("value", "arm_id")).alias("b"))
    wins = won.where("draw is null").select("test_id", "arm_id", "wins").unionByName(best.select("test_id", F.col("b.arm_id").alias("arm_id"), F.lit(1).cast("long").alias("wins")))
    wins = wins.groupBy("test_id", "arm_id").agg(F.sum("wins").alias("wins"))
    return a.select("test_id", "arm_id").join(wins, ["test_id", "arm_id"], "left").select("test_id", "arm_id", (F.coalesce("wins", F.lit(0)) / F.lit(draws)).alias("share"))


def should_stop(shares: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(test_id, stop, winner): the arm that is best often enough, if there is one."""
    best = shares.groupBy("test_id").agg(F.max(F.struct("share", "arm_id")).alias("b"))
    return best.select("test_id", (F.col("b.share") >= confidence).alias("stop"), F.when(F.col("b.share") >= confidence, F.col("b.arm_id")).alias("winner"))


def unit(v: Column) -> Column:
    """A vector of length 1 in the same direction; zeros stay."""
    v = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(1.0))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the unit mean of each label's unit vectors."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", unit(F.transform("v", lambda p: p["x"])).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_centroid(vectors: DataFrame, key: str, vector: str, of: DataFrame, limit: int = 10_000) -> DataFrame:
    """(key, label): the centroid with the largest product; ties to the smaller label. Centroids are few, and checked."""
    if of.limit(limit + 1).count() > limit:
        raise ValueError("too many centroids to send to every task")
    sides = F.broadcast(of.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("of")))  # one row
    all_ = vectors.select(key, unit(F.col(vector)).alias("v")).crossJoin(sides)
    scores = F.transform("of", lambda c: F.round(dot(F.col("v"), c["centroid"]), 9))
    best = F.element_at("of", F.array_position(scores, F.array_max(scores)).cast("int"))
    return all_.select(key, best["label"].alias("label"))
