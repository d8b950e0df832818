import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.operators import diagnostics as N
from trialworks.operators import lexicon as L
from trialworks.operators import ranking as K
from trialworks.operators import splits as G


def rows_of(spark):
    return spark.range(400).select("id", (F.col("id") / 4).cast("long").alias("group_id"), F.concat(F.lit("copy "), F.col("id")).alias("copy_text"))


def test_lock_refuses_changed_test_rows_and_logs_reads(spark, tmp_path):
    split = G.grouped_split(rows_of(spark))
    test, path = split.where("split = 'test'"), str(tmp_path)
    first = G.lock(test, path)
    assert G.lock(test.orderBy(F.desc("id")), path) == first  # another order
    edit = lambda s: split.withColumn("copy_text", F.when(F.col("id") == split.where(f"split = '{s}'").first().id, "edited").otherwise(F.col("copy_text")))
    assert G.lock(edit("train").where("split = 'test'"), path) == first
    with pytest.raises(ValueError, match="differ"):
        G.unlock_test(edit("test").where("split = 'test'"), path, "the one final evaluation of the ranker", "final")
    with pytest.raises(ValueError, match="20 characters"):
        G.unlock_test(test, path, "   just looking      ", "final")
    assert not (tmp_path / "reads").exists()  # refused reads are not logged
    assert G.unlock_test(test, path, "the one final evaluation of the ranker", "final").count() == test.count()
    G.unlock_test(test, path, "the one final evaluation of the ranker, again", "final")
    assert spark.read.parquet(f"{path}/reads").count() == 2


def test_dev_is_carved_by_whole_groups_and_strata_keep_their_shares(spark):
    parts = G.carve_dev(G.grouped_split(rows_of(spark)))
    assert parts.groupBy("group_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"fit": 60 * 4, "dev": 10 * 4}
    s = G.stratified_split(rows_of(spark).withColumn("source", F.when(F.col("group_id") < 20, "a").otherwise("b")), "source")
    assert {(r.source, r.split): r.n for r in s.groupBy("source", "split").agg(F.count_distinct("group_id").alias("n")).collect()} == {("a", "train"): 14, ("a", "val"): 3, ("a", "test"): 3, ("b", "train"): 56, ("b", "val"): 12, ("b", "test"): 12}


def test_baselines_bands_and_warnings(spark):
    with pytest.raises(Exception, match="near chance"):
        spark.range(1).select(N.plausible_baseline(F.lit(0.5), 0.66)).collect()
    with pytest.raises(Exception, match="above the ceiling"):
        spark.range(1).select(N.plausible_baseline(F.lit(0.7), 0.66)).collect()
    r = spark.range(1).select(K.verdict_band(F.lit(0.2), 0.1, 0.3).alias("b"), K.profile_warnings(F.lit(0.1), F.lit(9), F.lit(0.9)).alias("w"), K.interaction(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))).alias("x")).first()
    assert r.b == "optimal" and r.w == ["few rated words", "mostly capitals"] and r.x == [1, 2, 3, 5, -2, -3, 3, 10]


def test_allocation_prefers_the_better_arm(spark):
    arms = spark.createDataFrame([(1, "a", 5000, 150), (1, "b", 5000, 50), (2, "c", 100, 1), (3, "d", 0, 0), (3, "e", 0, 0)], "test_id long, arm_id string, impressions long, clicks long")
    share = {(r.test_id, r.arm_id): r.share for r in K.allocate(arms, 500).collect()}
    assert share[1, "a"] > 0.99 and share[2, "c"] == 1 and abs(share[3, "d"] - 0.5) < 0.1
    stop = {r.test_id: r.winner for r in K.should_stop(K.allocate(arms, 500)).collect()}
    assert stop == {1: "a", 2: "c", 3: None}


def test_ridge_equals_numpy(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(200, 3)), draw.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    assert np.allclose(K.ridge(df, ["a", "b", "c"], "y", 2.0), np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ y))


def test_features_of_rated_words(spark):
    lex = spark.createDataFrame([("cat", 8.0, 2.0, 5.0, 5.0), ("dog", 2.0, 6.0, 4.0, None), ("sun", 5.0, 5.0, 6.0, 1.0)], "word string, valence double, arousal double, dominance double, concreteness double")
    for a, b in L.SEGMENTS.values():
        for s in (a, b):
            lex = lex.withColumns({f"{d}_{s}": F.col(d) + (0.5 if s == a else 0.0) for d in ("valence", "arousal")})
    docs = spark.createDataFrame([(1, "The cat and the dog. Cat!"), (2, "the of and"), (3, None), (4, "unknown words")], "doc_id long, text string")
    f = {r.doc_id: r for r in L.lexicon_features(docs, lex).collect()}
    assert f[1].valence_range == 6 and f[1].valence_pos_frac == pytest.approx(2 / 3) and f[1].vad_coverage == 1 and f[1].conc_coverage == pytest.approx(2 / 3)
    mean, sd = np.mean([2, 6, 5]), np.std([2, 6, 5])
    assert f[1].arousal_top3_z == pytest.approx((np.mean([6, 2, 2]) - mean) / sd) and f[1].first_word_arousal_z == pytest.approx((2 - mean) / sd)
    assert f[1].valence_gender_gap == pytest.approx(0.5)
    assert len(f) == 4 and all(v == 0 for d in (2, 3, 4) for k, v in f[d].asDict().items() if k != "doc_id") and not any(isinstance(v, float) and math.isnan(v) for r in f.values() for v in r)


def test_norms_need_three_ratings(spark):
    raw = spark.createDataFrame([("Cat ", "7.12345", "3", "5", "4"), ("dog", "x", "3", "5", "4"), ("", "1", "1", "1", "1"), ("sun", "1", "2", "3", None)], "word string, valence string, arousal string, dominance string, concreteness string")
    assert sorted((r.word, r.valence, r.concreteness) for r in L.read_norms(raw).collect()) == [("cat", 7.123, 4.0), ("sun", 1.0, None)]


def test_allocation_by_plain_draws_whatever_the_groups(spark):
    import hashlib
    import math

    rows = [(t, ("arm é " if a % 3 else "x" * 50) + "y" * a, 100 + 10 * a, (7 * a + t) % 20) for t in (1, 2, 12345) for a in range(9)] + [(3, "only", 10, 1)]
    h = lambda k, s: int(hashlib.md5(f"{k}|{s}".encode()).hexdigest()[:13], 16) / 2**52
    wins: dict = {}
    for d in range(1, 121):
        best: dict = {}
        for t, a, n, c in rows:
            al, be = 0.5 + c, 39.5 + n - c
            k = f"{t}/{a}/{d}"
            v = al / (al + be) + math.sqrt(al * be / ((al + be) ** 2 * (al + be + 1))) * math.sqrt(-2 * math.log(max(h(k, 21), 1e-12))) * math.cos(2 * math.pi * h(k, 22))
            best[t] = max(best.get(t, (-1, "")), (round(min(1, max(0, v)), 12), a))
        for t, (_, a) in best.items():
            wins[t, a] = wins.get((t, a), 0) + 1
    arms = spark.createDataFrame(rows, "test_id long, arm_id string, impressions long, clicks long")
    for part in (4096, 2):
        got = {(r.test_id, r.arm_id): round(r.share * 120) for r in K.allocate(arms, 120, part=part).collect()}
        assert got == {(t, a): wins.get((t, a), 0) for t, a, _, _ in rows}
