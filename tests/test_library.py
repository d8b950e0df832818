import math

import pytest
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.functions import text as X
from trialworks.operators import effects as E
from trialworks.operators import privacy as P
from trialworks.operators import splits as G
from trialworks.operators import study as Q
from trialworks.operators.components import connected_components
from trialworks.operators.prefix import sum_before
from trialworks.streaming import jobs


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_statistics(spark):
    r = one(spark, p0=S.mcnemar_exact(F.lit(0), F.lit(0)), p1=S.mcnemar_exact(F.lit(1), F.lit(8)), lo=S.wilson(F.lit(0), F.lit(0))[0], n=S.items_needed(F.lit(0.55), F.lit(0.62)),
            none=S.required_impressions(F.lit(0.0), F.lit(0.1)), need=S.required_impressions(F.lit(0.5), F.lit(0.1)), big=S.sigmoid(F.lit(-900.0)), few=S.outcomes_needed(F.lit(0.4)))
    assert r.p0 == 1 and r.p1 == pytest.approx(2 * (1 + 9) / 512) and r.lo == 0 and r.n > 0 and r.none is None and r.few is None and r.big == pytest.approx(0)
    assert r.need == math.ceil(2 * (1.96 / 0.5) ** 2 * (10 + 1 / 0.9))


def test_surface_features_of_a_known_line(spark):
    f = one(spark, **X.surface(F.lit("Save 20% today. Limited time only!")))
    assert f.n_chars == 34 and round(f.punct_density, 6) == 0.058824 and f.exclaim_count == 1


@pytest.mark.parametrize("text,kinds", [
    ("write to a.b@example.com", {"email"}), ("card 4111 1111 1111 1111", {"credit_card"}), ("call +1 (415) 555-2671", {"phone"}), ("ssn 123-45-6789", {"ssn"}),
    ("from 192.168.0.1", {"ip_address"}), ("born 12/05/1980", {"date_of_birth"}), ("at 221 Baker Street", {"postal_address"}),
    ("Sale ends 31/12/2025", set()), ("version 2.10.4 is out", set()), ("1,000,000 impressions in 2024", set()), ("Save 20% today", set()),
])
def test_personal_data(spark, text, kinds):
    found = {r["kind"] for r in one(spark, r=P.scan_pii(F.lit(text))).r}
    assert kinds <= found and (kinds or not found)


def test_gate_names_kinds_only(spark):
    df = spark.createDataFrame([(1, "me@example.com"), (2, "fine")], "id long, copy string")
    with pytest.raises(ValueError, match="email") as e:
        P.pii_gate(df, "id")
    assert "me@" not in str(e.value) and P.pii_gate(df.where("id = 2"), "id").count() == 1


def test_components_of_chains_stars_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(5000, i) for i in range(5001, 5200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (1, 2)], "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 5000 for i in range(5000, 5200)} | {1: 1, 2: 1}


def test_sum_before(spark):
    df = spark.range(0, 5000, 7).select("id", F.col("id").alias("v"))
    got = {r.id: r.s for r in sum_before(df, [], "id", "v", "s", 100).collect()}
    total = 0
    for i in range(0, 5000, 7):
        assert got[i] == total
        total += i


def test_split_keeps_groups_and_lock_notices_edits(spark):
    rows = spark.range(400).select("id", (F.col("id") / 4).cast("long").alias("group_id"), F.concat(F.lit("copy "), F.col("id")).alias("copy_text"))
    split = G.grouped_split(rows)
    assert {r.rule: r.violations for r in G.verify_split(split).collect()} == {"no split": 0, "group crosses": 0, "copy crosses": 0}
    assert {r.split: r.n_groups for r in G.split_profile(split, "id").collect()} == {"train": 70, "val": 15, "test": 15}
    test = split.where("split = 'test'")
    before = G.fingerprint(test).first().fingerprint
    assert before == G.fingerprint(test.orderBy(F.desc("id"))).first().fingerprint
    edited = test.withColumn("copy_text", F.when(F.col("id") == test.first().id, "edited").otherwise(F.col("copy_text")))
    assert before != G.fingerprint(edited).first().fingerprint


def test_chain_and_seal_break_on_edits(spark):
    chain = Q.audit_chain(spark.createDataFrame([("t1", i, f"p{i}") for i in range(5)] + [("t2", 0, "x")], "tenant_id string, seq long, payload string"))
    assert all(r.first_broken is None for r in Q.verify_chain(chain).collect())
    broken = chain.withColumn("payload", F.when((F.col("seq") == 2) & (F.col("tenant_id") == "t1"), "edited").otherwise(F.col("payload")))
    assert {r.tenant_id: r.first_broken for r in Q.verify_chain(broken).collect()} == {"t1": 3, "t2": None}
    p = spark.createDataFrame([(1, "2024-01-01", ["a", "b"], 0, "high", 1.0, None, 1)], "id long, created_at string, variants array<string>, predicted_winner int, tier string, margin double, user_pick int, actual int")
    sealed = Q.seal(p)
    assert Q.verify_seal(sealed.withColumn("actual", F.lit(0))).first().intact and not Q.verify_seal(sealed.withColumn("margin", F.lit(2.0))).first().intact


def test_pairs_are_oriented_and_empty_tables_work(spark):
    arms = spark.createDataFrame([(1, "a", "x", 1000, 50), (1, "b", "y", 1000, 20), (1, "c", "y", 1000, 30), (2, "d", "z", 1000, 5), (3, "e", "", 1000, 5)], "test_id long, arm_id string, copy_text string, impressions long, clicks long")
    got = {(r.hi_id, r.lo_id) for r in E.build_pairs(E.labelled_arms(arms)).collect()}
    assert got == {("a", "b"), ("a", "c")}
    assert E.build_pairs(E.labelled_arms(arms.limit(0))).count() == 0


def test_streams_equal_the_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 50).alias("id"), (F.col("id") % 3).alias("test_id"), F.lit(1).alias("impressions"), (F.col("id") % 2).alias("clicks"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 2).cast("int").alias("actual"), F.timestamp_seconds("id").alias("resolved_at"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    jobs.drain(jobs.first_sight(stream(), late="365 days"), f"{tmp_path}/first", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/first").count() == 50
    jobs.drain(jobs.write_once(stream()), f"{tmp_path}/once", f"{tmp_path}/c2")
    once = spark.read.parquet(f"{tmp_path}/once")
    assert once.count() == 300 and once.where("accepted").count() == 50 and once.where("accepted").select("id").distinct().count() == 50
    batch = {(r.start, r.test_id): r.clicks for r in jobs.windowed_rates(rows).collect()}
    jobs.drain(jobs.windowed_rates(stream()), f"{tmp_path}/win", f"{tmp_path}/c3")
    done = {(r.start, r.test_id): r.clicks for r in spark.read.parquet(f"{tmp_path}/win").collect()}
    assert done and done.items() <= batch.items()


def test_exact_p_values_of_many_discordant_items(spark):
    def plain(b, c):
        n, k = b + c, min(b, c)
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, terms))) if n else 1.0

    pairs = [(0, 0), (0, 1), (5, 0), (1, 8), (8, 1), (15, 16), (16, 17), (20, 40), (31, 31), (500, 580), (120_000, 121_500), (400_000, 400_000), (0, 2_000)]
    got = spark.createDataFrame(pairs, "b long, c long").withColumn("p", S.mcnemar_exact("b", "c")).collect()
    for r in got:  # the last two sizes would take 10^10 steps and more if each term had its own factorials
        assert r.p == pytest.approx(plain(r.b, r.c), rel=1e-7, abs=1e-300), (r.b, r.c)
