"""Rankers fitted on pairs, their ensembles, clusters of vectors, hashed text vectors, and a batch compared in three layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.functions import text as X
from trialworks.operators.effects import MOST_PAIRS, ranked
from trialworks.operators.ranking import centroids, dot, guard_ranking, unit
from trialworks.operators.ranks import within_budget
from trialworks.storage import written


def pair_differences(pairs: DataFrame, arms: DataFrame, features: list[str]) -> DataFrame:
    """test_id, weight and the winner's features less the loser's. ``pairs`` as build_pairs gives them; an arm's features
    are finite numbers. The weight is the gap by the pair's harmonic precision."""
    side = lambda s: arms.select("test_id", F.col("arm_id").alias(f"{s}_id"), *[F.col(f).cast("double").alias(f"{s}_{f}") for f in features])
    both = pairs.join(side("hi"), ["test_id", "hi_id"]).join(side("lo"), ["test_id", "lo_id"])
    return both.select("test_id", (F.col("gap") * F.col("pair_weight")).alias("weight"), *[(F.col(f"hi_{f}") - F.col(f"lo_{f}")).alias(f) for f in features])


def arm_differences(arms: DataFrame, features: list[str], min_gap: float = 0.05, block: int = 256, most: int = MOST_PAIRS) -> DataFrame:
    """What :func:`pair_differences` gives for build_pairs of ``arms`` (test_id, arm_id, copy_text, target, weight, features),
    without moving a pair: an experiment's arms are written once, in blocks, and each use of the result makes the pairs of
    two blocks anew from their row. More than ``most`` pairs of one experiment are an error."""
    columns = ["arm_id", "copy_text", "target", "weight", *features]
    arms = within_budget(arms.select("test_id", "arm_id", "copy_text", "target", "weight", *[F.col(f).cast("double").alias(f) for f in features]), ["test_id"], most)
    blocks = F.ceil(F.count("*").over(Window.partitionBy("test_id")) / block)
    parts = arms.withColumn("block", F.pmod(F.xxhash64("arm_id"), blocks)).groupBy("test_id", "block").agg(F.collect_list(F.struct(*columns)).alias("of"))
    parts = written(parts, "blocks")
    side = lambda a: parts.select("test_id", F.col("block").alias(f"block_{a}"), F.col("of").alias(f"of_{a}"))
    both = written(side("a").join(side("b"), "test_id").where("block_a <= block_b"), "block-pairs")
    rows = both.select("test_id", "block_a", "block_b", F.explode("of_a").alias("a"), "of_b").select("test_id", "block_a", "block_b", "a", F.explode("of_b").alias("b"))
    gap = F.col("a.target") - F.col("b.target")
    rows = rows.where("(a.arm_id < b.arm_id or block_a < block_b) and a.copy_text <> b.copy_text").where(F.abs(gap) >= min_gap)  # equal ids lie in one block
    return rows.select("test_id", (F.abs(gap) * (2 / (1 / F.col("a.weight") + 1 / F.col("b.weight")))).alias("weight"), *[((F.col(f"a.{f}") - F.col(f"b.{f}")) * F.signum(gap)).alias(f) for f in features])


def fit_pairwise_ranker(differences: DataFrame, features: list[str], penalty: float = 1e-4, rounds: int = 50, close: float = 1e-9) -> list[float]:
    """Weights of the linear score whose logistic loss on winner less loser is least, by the pairs' weights.

    There is no intercept, and half of ``penalty`` times the squared weights, each by its feature's spread, is added to the
    mean loss. Newton's method: a round is one aggregate over ``differences``, of the loss, its slopes and their slopes, and
    only these sums reach the driver. Nothing is cached, so differences should be cheap to read again
    (:func:`arm_differences`, a written table). A step that does not lower the loss is halved.
    """
    d, n = differences.where("weight > 0"), len(features)
    x, lower = [F.col(f) for f in features], [(i, j) for i in range(n) for j in range(i + 1)]
    w, at, step, best, spread = F.col("weight"), np.zeros(n), np.zeros(n), None, None
    for _ in range(rounds):
        m = linear_score(features, [float(v) for v in at + step])
        d_ = d.withColumn("__m", m).withColumn("__p", 1 / (1 + F.exp(F.col("__m"))))  # how sure the loser is called
        p, h = F.col("__p") * w, F.col("__p") * (1 - F.col("__p")) * w
        r = d_.agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * S.softplus(-F.col("__m"))).alias("loss"), *[F.sum(p * x[i]).alias(f"g{i}") for i in range(n)],
                   *[F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in lower]).first()
        if r.w is None:
            return [0.0] * n
        if spread is None:  # at weights of 0, p (1 - p) is a quarter; each pair counts in both directions, so the mean is 0
            spread = np.array([4 * r[f"h{i}_{i}"] / max(r.w - r.ww / r.w / 2, 1e-300) for i in range(n)])
            used = spread > 0
        there = at + step
        loss = r.loss / r.w + penalty / 2 * float(spread @ there**2)
        if best is not None and not loss <= best:
            if np.abs(step).max() <= close * max(1.0, np.abs(at).max()):
                break
            step = step / 2
            continue
        gained, at, best = np.inf if best is None else best - loss, there, loss
        slope = np.array([r[f"g{i}"] for i in range(n)]) / r.w - penalty * spread * at
        curve = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) / r.w + np.diag(penalty * spread)
        step = np.zeros(n)
        step[used] = np.linalg.lstsq(curve[np.ix_(used, used)], slope[used], rcond=None)[0]
        if gained <= close * best or not np.abs(step).max(initial=0.0):  # what is left is of the square of this
            break
    return [float(v) for v in at]


def linear_score(features: list[str], weights: list[float]) -> Column:
    return sum((F.col(f) * F.lit(w) for f, w in zip(features, weights)), F.lit(0.0))


def bagged_ensemble(differences: DataFrame, arms: DataFrame, features: list[str], members: int = 3, share: float = 0.8, penalty: float = 1e-4) -> DataFrame:
    """The arms with score: the mean of the members' scores, each less its mean over its spread. A member is fitted on the
    experiments that its hash draws, whole."""
    scores = []
    for k in range(members):
        drawn = differences.where(S.hash01(F.col("test_id"), 90 + k) < share)
        scores.append(linear_score(features, fit_pairwise_ranker(drawn, features, penalty)).alias(f"m{k}"))
    rows = arms.select("*", *scores)
    stats = rows.agg(*[f(f"m{k}").alias(f"{n}{k}") for k in range(members) for n, f in (("avg", F.avg), ("sd", F.stddev_pop))])
    z = [(F.col(f"m{k}") - F.col(f"avg{k}")) / F.when(F.col(f"sd{k}") > 0, F.col(f"sd{k}")).otherwise(1.0) for k in range(members)]
    return rows.crossJoin(F.broadcast(stats)).select(*arms.columns, (sum(z, F.lit(0.0)) / members).alias("score"))  # one row on the right


def topic_clusters(vectors: DataFrame, key: str, vector: str, k: int = 8, seed: int = 7) -> DataFrame:
    """(key, cluster) by k-means on directions; a cluster bears the least key in it, so its name does not hang on the run.
    Vectors without a direction (null or all zeros) are in no cluster: null."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(key), unit(F.col(vector)).alias("v"))
    sound = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    x = rows.where(sound).select(key, array_to_vector("v").alias("x"))
    found = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="c", distanceMeasure="cosine").fit(x).transform(x).select(key, "c")
    names = found.groupBy("c").agg(F.min(key).alias("cluster"))
    named = found.join(F.broadcast(names), "c").select(key, "cluster")  # k rows
    return named.unionByName(rows.where(~sound).select(key, F.lit(None).cast(dict(named.dtypes)["cluster"]).alias("cluster")))


def distinctive_clusters(vectors: DataFrame, label: str, vector: str, least: int = 1) -> DataFrame:
    """(label, size, distinctiveness, chosen): 1 less the cosine of a cluster's centre and the mean of all other centres;
    the most distinctive of at least ``least`` vectors is chosen, ties to the smaller label. A row per cluster."""
    c = centroids(vectors, label, vector)
    long = c.select("label", F.posexplode("centroid").alias("i", "x"))
    all_ = long.groupBy("i").agg(F.sum("x").alias("total"))
    others = long.join(F.broadcast(all_), "i").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x", (F.col("total") - F.col("x")).alias("rest")))).alias("p"))  # a row per dimension
    d = others.select("label", (1 - dot(F.transform("p", lambda p: p["x"]), unit(F.transform("p", lambda p: p["rest"])))).alias("distinctiveness"))
    out = d.join(vectors.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size")), "label")
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("size") >= least), F.desc(F.round("distinctiveness", 9)), "label"))  # a row per cluster
    return out.select("label", "size", "distinctiveness", ((F.col("size") >= least) & (rank == 1)).alias("chosen"))


def text_vectors(docs: DataFrame, dimensions: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, place, x): the hashed TF-IDF vector of each text, of length 1, as a row per place that is not 0.

    A text's words are counted and hashed in its own row, and a document stays a row of places and counts until the end, so
    only documents that repeat an id are shuffled; rows without an id are one document. The driver holds a number per place.
    Texts without a word, or whose words all texts have, give no row. An encoder of one's own takes this one's place by
    returning the same columns.
    """
    token = X.TOKEN

    def count(batches):
        import re
        from collections import Counter
        from hashlib import md5

        import pyarrow as pa

        words, known = re.compile(token), {}  # of each word, its place
        for b in batches:
            places, counts, ends = [], [], [0]
            for t in b.column("text"):
                of: dict[int, int] = {}
                for word, n in Counter(words.findall(t.as_py())).items():
                    place = known.get(word)
                    if place is None:
                        if len(known) >= 500_000:
                            known.clear()
                        place = known[word] = int(int(md5(f"{word}|80".encode()).hexdigest()[:13], 16) / 2.0**52 * dimensions)  # S.hash01(word, 80)
                    of[place] = of.get(place, 0) + n
                places += of
                counts += of.values()
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int64())) for v in (places, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], ["doc_id", "place", "n"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tf = written(rows.mapInArrow(count, f"doc_id {kind}, place array<long>, n array<long>"), "counts")
    repeats = written(tf.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id")), "repeats")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    merged = tf.join(repeats, same, "left_semi").select("doc_id", F.explode(F.arrays_zip("place", "n")).alias("p")).groupBy("doc_id", "p.place").agg(F.sum("p.n").alias("n"))
    merged = merged.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("p")).select("doc_id", F.col("p.place").alias("place"), F.col("p.n").alias("n"))
    whole = tf.join(repeats, same, "left_anti").unionByName(merged)
    df = whole.select(F.explode("place").alias("place")).groupBy("place").agg(F.count("*").alias("texts")).crossJoin(F.broadcast(tf.agg(F.count_distinct("doc_id").alias("all"))))
    idf = np.zeros(dimensions)
    for r in df.select("place", F.ln((F.col("all") + 1) / (F.col("texts") + 1)).alias("idf")).collect():  # a row per place
        idf[r.place] = r.idf

    def weigh(batches):
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                place, n = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "n"))
                of = np.repeat(np.arange(part.num_rows), part.column("place").value_lengths().to_numpy(zero_copy_only=False))
                w = n * idf[place]
                size = np.sqrt(np.bincount(of, w * w, part.num_rows))
                keep = w > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of[keep])), pa.array(place[keep]), pa.array(w[keep] / size[of[keep]])], ["doc_id", "place", "x"])

    return whole.mapInArrow(weigh, f"doc_id {kind}, place long, x double")


def compare_batch(variants: DataFrame, score: str, text: str, group: str = "test_id", key: str = "arm_id") -> DataFrame:
    """A row per variant with three layers that do not touch each other: ranking (rank, margin), profile (surface features)
    and guardrails (max_severity, and caution for the group). The order is the score's alone."""
    r = ranked(variants, score, key, group)
    f = X.surface(F.col(text))
    out = r.select(group, key, "rank", "margin", F.struct(*[f[n].cast("double").alias(n) for n in ("n_words", "avg_word_len", "caps_ratio", "punct_density")]).alias("profile"),
                   X.max_severity(X.guardrails(F.col(text))).alias("max_severity"))
    return out.join(guard_ranking(r, text, group), group)
