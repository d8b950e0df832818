from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.operators import models as M
from trialworks.operators import splits as G


def arms_of(spark):
    """Experiments of four arms; a is what makes an arm win, b is noise."""
    h = lambda k: S.hash01("id", k) - 0.5
    arms = spark.range(1200).select((F.col("id") / 4).cast("long").alias("test_id"), F.concat(F.lit("arm "), F.col("id")).alias("arm_id"), h(1).alias("a"), h(2).alias("b"), h(3).alias("e"))
    arms = arms.withColumn("y", 2 * F.col("a") + 0.3 * F.col("e"))
    x, z = arms.alias("x"), arms.alias("z")
    pairs = x.join(z, (F.col("x.test_id") == F.col("z.test_id")) & (F.col("x.y") > F.col("z.y")))
    return arms, pairs.select("x.test_id", F.col("x.arm_id").alias("hi_id"), F.col("z.arm_id").alias("lo_id"), (F.col("x.y") - F.col("z.y")).alias("gap"), F.lit(1.0).alias("pair_weight"))


def test_ranker_and_ensemble_find_what_wins(spark):
    arms, pairs = arms_of(spark)
    diff = M.pair_differences(pairs, arms, ["a", "b"])
    w = M.fit_pairwise_ranker(diff.where("test_id % 5 <> 0"), ["a", "b"])
    assert w[0] > 10 * abs(w[1])
    right = diff.where("test_id % 5 = 0").agg(F.avg((M.linear_score(["a", "b"], w) > 0).cast("double"))).first()[0]
    assert right > 0.9
    scored = M.bagged_ensemble(diff, arms, ["a", "b"], members=2)
    assert scored.count() == arms.count() and scored.agg(F.corr("score", "a")).first()[0] > 0.99


def test_clusters_follow_directions_and_bear_their_least_key(spark):
    rows = [(i, [1.0 + i % 2, 0.01 * i, 0.0] if i < 10 else [0.0, 0.01 * i, 3.0]) for i in range(20)] + [(20, None), (21, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.cluster for r in M.topic_clusters(v, "id", "v", k=2).collect()}
    assert got == {i: 0 if i < 10 else 10 for i in range(20)} | {20: None, 21: None}
    named = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.9, 0.1]), (2, "z", [0.0, 1.0]), (3, "z", [0.0, 2.0]), (4, "w", [-1.0, 0.0])], "id long, label string, v array<double>")
    got = {r.label: r for r in M.distinctive_clusters(named, "label", "v", 2).collect()}
    assert [k for k, r in got.items() if r.chosen] == ["z"]  # w is further off, but too small
    assert max(got.values(), key=lambda r: r.distinctiveness).label == "w"


def test_text_vectors_have_length_one(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None), (4, "")], "doc_id long, text string")
    got = M.text_vectors(docs).groupBy("doc_id").agg(F.sum(F.col("x") * F.col("x")).alias("n"), F.max("x").alias("top")).collect()
    assert {r.doc_id: round(r.n, 9) for r in got} == {1: 1.0, 2: 1.0}


def test_batch_layers_do_not_change_the_order(spark):
    rows = spark.createDataFrame([(1, "a", "QUIET WORDS HERE NOW", 0.9), (1, "b", "quiet words here now", 0.5)], "test_id long, arm_id string, text string, score double")
    got = {r.arm_id: r for r in M.compare_batch(rows, "score", "text").collect()}
    assert got["a"]["rank"] == 1 and got["a"].max_severity > 0 == got["b"].max_severity and got["a"].caution and got["b"].caution


def test_read_log_is_empty_until_the_first_read(spark, tmp_path):
    test = spark.range(5).withColumn("copy_text", F.col("id").cast("string"))
    assert G.read_log(spark, str(tmp_path)).count() == 0
    G.unlock_test(test, str(tmp_path), "the one final evaluation", "final")
    assert [(r.evaluation, r.n) for r in G.read_log(spark, str(tmp_path)).collect()] == [("final", 5)]


def test_pairs_made_from_blocks_are_those_of_the_joins(spark):
    from trialworks.operators import effects as E

    h = lambda k: S.hash01("id", k)
    rows = spark.range(400).select(F.floor(F.sqrt("id")).alias("test_id"), F.concat(F.lit("arm "), F.col("id")).alias("arm_id"), F.concat(F.lit("copy "), (F.col("id") % 13).cast("string")).alias("copy_text"),
                                   F.round(h(1), 1).alias("target"), (1 + h(2)).alias("weight"), h(3).alias("a"), (F.col("id") % 5).alias("b"))
    want = M.pair_differences(E.build_pairs(rows), rows, ["a", "b"])
    got = M.arm_differences(rows, ["a", "b"], block=7)
    as_set = lambda d: sorted((r.test_id, round(r.weight, 9), round(r.a, 9), round(r.b, 9)) for r in d.collect())
    assert as_set(got) == as_set(want) and len(as_set(got)) > 3000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # a pass over the pairs moves none


def test_text_vectors_by_plain_counts_with_repeated_and_missing_ids(spark):
    import hashlib
    import math
    import re
    from collections import Counter

    rows = [(1, "Red red fox-trot"), (2, "blue fox don't"), (2, "red sky"), (None, "sky"), (None, "fox fox"), (3, None), (4, "- 12"), (5, "\u0130stanbul RED " + "word " * 3000)]
    place = lambda w: int(int(hashlib.md5(f"{w}|80".encode()).hexdigest()[:13], 16) / 2**52 * 4096)
    docs: dict = {}
    for i, t in rows:
        docs.setdefault(i, Counter()).update(place(w) for w in re.findall("[a-z][a-z'-]*", (t or "").lower()))
    texts, want = Counter(p for c in docs.values() for p in c), {}
    for i, c in docs.items():
        w = {p: n * math.log((5 + 1) / (texts[p] + 1)) for p, n in c.items()}  # five ids that are not null
        size = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, p): round(x / size, 9) for p, x in w.items() if x > 0}
    out = M.text_vectors(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.place): round(r.x, 9) for r in out.collect()} == want and any(i is None for i, _ in want)
