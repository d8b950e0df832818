import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.operators import controls as C
from trialworks.operators import lexicon as L
from trialworks.operators import privacy as P
from trialworks.operators import study as Q
from trialworks.sources import readers as R
from trialworks.streaming import jobs as J


def log(spark, tmp_path, rows, schema):
    """A log of one file per entry of rows, and its stream, a file a trigger."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"log/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "log/*"))


def test_audit_chain_goes_on_over_triggers(spark, tmp_path):
    schema = "tenant_id string, seq long, payload string"
    parts = [[("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], [("a", 3, "z")], [("b", 2, "w"), ("a", 4, "")]]
    got = J.settled(J.chained(log(spark, tmp_path, parts, schema)), "chain")
    whole = Q.audit_chain(spark.createDataFrame(sum(parts, []), schema))
    assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert all(r.first_broken is None for r in Q.verify_chain(got).collect())


def test_write_once_keeps_the_first_over_triggers(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    parts = [[(1, 1, t(5)), (1, 0, t(3)), (2, 1, t(2))], [(1, 1, t(1)), (3, 0, t(1))]]
    got = J.settled(J.write_once(log(spark, tmp_path, parts, "id long, actual int, resolved_at timestamp")), "once")
    assert sorted((r.id, r.actual, r.accepted) for r in got.collect()) == [(1, 0, True), (1, 1, False), (1, 1, False), (2, 1, True), (3, 0, True)]


def test_settled_holds_the_last_state_in_complete_mode_and_nothing_of_an_empty_log(spark, tmp_path):
    schema = "test_id long, arm long, impressions int, clicks int"
    got = J.settled(J.arm_counters(log(spark, tmp_path, [[(1, 1, 1, 0), (1, 2, 1, 1)], [(1, 1, 1, 1)]], schema)), "counters", "complete")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1), (1, 2, 1, 1)]
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert J.settled(none, "none").collect() == []


def test_ingest_resumes_and_leaves_out_loads_cut_off(spark, tmp_path):
    rows, path = spark.range(10).withColumn("v", F.col("id") * 2), str(tmp_path / "t")
    assert R.incremental_ingest(rows.where("id < 4"), path, "id") == 4
    rows.where("id = 5").write.parquet(f"{path}/load-cut-off")  # written, never noted as whole
    assert R.ingested(spark, path).count() == 4
    assert R.incremental_ingest(rows.unionByName(rows), path, "id") == 6  # repeated keys once
    assert R.incremental_ingest(rows, path, "id") == 0
    assert sorted(map(tuple, R.ingested(spark, path).collect())) == [(i, 2 * i) for i in range(10)]


def test_labelled_arms_come_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "F", 1.5), ("b", "O", None)], "arm_id string, release string, target double")
    back = R.write_labelled_arms(rows, str(tmp_path / "arms"))
    assert back.columns == rows.columns and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_tenant_stamp_overrides_a_forged_tenant(spark):
    rows = spark.createDataFrame([(1, "other-one")], "id long, tenant_id string")
    assert P.tenant_stamp(rows, "tenant-7").first().tenant_id == "tenant-7"
    with pytest.raises(ValueError, match="tenant"):
        P.tenant_stamp(rows, "../etc")


def test_activations(spark):
    import math

    xs = [-30.0, -1.0, 0.0, 0.5, 4.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.erf(F.col("x")).alias("erf"), S.gelu(F.col("x")).alias("gelu")).collect():
        assert abs(r.erf - math.erf(r.x)) < 2e-7 and abs(r.gelu - r.x * 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-5
    v = spark.range(1).select(S.layer_norm(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)), 0.0).alias("v")).first().v
    assert [round(x, 6) for x in v] == [round((x - 3) / math.sqrt(14 / 3), 6) for x in (1, 2, 6)]


def test_word_tables(spark):
    docs = spark.createDataFrame([(1, "Happy happy cat"), (2, "nothing known"), (3, None)], "doc_id long, text string")
    freq = spark.createDataFrame([("happy", 6.0), ("cat", 2.0), ("known", 0.0)], "word string, zipf double")
    got = {r.doc_id: r for r in L.frequency_features(docs, freq).collect()}
    assert (got[1].zipf_min, got[1].rare_word_frac, got[1].common_word_frac) == (2.0, 1 / 3, 2 / 3) and abs(got[1].zipf_mean - 14 / 3) < 1e-12
    assert tuple(got[2])[1:] == tuple(got[3])[1:] == (0.0,) * 5
    tags = spark.createDataFrame([("happy", ["joy", "positive"]), ("cat", ["fear", "negative"])], "word string, tags array<string>")
    got = {r.doc_id: r for r in L.emotion_features(docs, tags).collect()}
    assert (got[1].emo_joy, got[1].emo_fear, got[1].emo_diversity, got[1].emo_intensity, got[1].emo_neg_minus_pos) == (2 / 3, 1 / 3, 0.25, 2 / 3, -1 / 3)
    assert all(x == 0 for x in tuple(got[3])[1:])


def test_controls_tell_a_signal_from_none(spark):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 40).alias("g"), (S.hash01("id", 1) - 0.5).alias("x"), (S.hash01("id", 2) - 0.5).alias("noise"), (F.col("id") % 5 != 0).alias("fit"))
    signal = rows.withColumn("y", F.col("x") + F.col("noise"))
    got = {r.variant: r for r in C.label_permutation_control(signal, ["x"], "y", "g", F.col("id")).collect()}
    assert got["real"].passed and 0.4 < got["real"].val_r2 < 0.6 and all(abs(got[f"shuffled {k}"].val_r2) < 0.1 for k in (1, 2, 3))
    floor = {r.variant: r.val_r2 for r in C.baseline_floor(signal, ["x"], "y").collect()}
    assert floor["mean"] < 0.01 < floor["ridge"]
    assert all(r.sound for r in C.learning_curve(signal, ["x"], "y", F.col("id")).collect())


def test_replications_agree_where_arms_differ(spark):
    arms = spark.createDataFrame([(1, "a", 100_000, 1_000), (1, "b", 100_000, 5_000), (2, "a", 50, 5), (2, "b", 50, 5)], "test_id long, arm_id string, impressions long, clicks long")
    got = C.replication_ceiling(arms.where("test_id = 1"), [0.05], 20).first()
    assert got.ceiling == 1.0 and got.pairs == 1
    assert C.replication_ceiling(arms.where("test_id = 2"), [0.0], 200).first().ceiling < 0.7


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "from trialworks.plans import registry as r; assert set(r.oracle_sql()) <= set(r.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
