import itertools
import math
import random
import re
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.operators import audience as A
from trialworks.operators import privacy as P
from trialworks.operators import study as Q
from trialworks.operators import tenants as T
from trialworks.sources import readers as R


# Vendors' files.
@pytest.mark.parametrize("header,named", [
    ("Ad name,Title,Body,Impressions,Link clicks,Amount spent (GBP)", {"campaignId": "Ad name", "copy": "Title", "impressions": "Impressions", "clicks": "Link clicks"}),
    ("Campaign,Headline 1,Description,Impr.,Clicks", {"campaignId": "Campaign", "copy": "Headline 1", "impressions": "Impr.", "clicks": "Clicks"}),
    ("Ad copy,Reach,Website link clicks,Age range,Gender", {"copy": "Ad copy", "impressions": "Reach", "clicks": "Website link clicks", "segment": "Age range"}),
    ("ad_copy,views,Unique clicks,Audience,ad id", {"copy": "ad_copy", "impressions": "views", "clicks": "Unique clicks", "segment": "Audience", "campaignId": "ad id"}),
    ("Description 2,impression,All link clicks,sex", {"copy": "Description 2", "impressions": "impression", "clicks": "All link clicks", "segment": "sex"}),
    ("Copy length,Clicks per view,CTR", {}),
])
def test_headers_of_exports(header, named):
    assert R.resolve_headers(header.split(",")) == named


def test_campaign_export_reads_quoted_lines_and_tells_what_is_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Ad name,Body,Body,Impr.,Clicks\n c1 ,"Save, ""now""\nor never", other ,"1,000",5\n')
    rows, missing = R.read_campaign_export(spark, str(tmp_path / "a.csv"))
    assert missing == [] and [tuple(r) for r in rows.collect()] == [('Save, "now"\nor never', "1,000", "5", None, "c1")]
    (tmp_path / "b.csv").write_text("Body,Spend\nx,1\n")
    assert R.read_campaign_export(spark, str(tmp_path / "b.csv")) == (None, ["impressions", "clicks"])


def test_missing_releases_are_skipped_with_a_warning(spark, tmp_path):
    (tmp_path / "a.csv").write_text("headline,impressions,clicks,extra\nHello,10,1,x\n")
    with pytest.warns(UserWarning, match="release two is missing"):
        out = R.read_experiments(spark, {"one": str(tmp_path / "a.csv"), "two": str(tmp_path / "none.csv")})
    assert [(r.copy_text, r.impressions, r.lede, r.release) for r in out.collect()] == [("Hello", "10", None, "one")]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert R.read_experiments(spark, {}).columns == out.columns and R.read_experiments(spark, {}).count() == 0


def test_nested_lines_that_do_not_fit_are_held_back(spark, tmp_path):
    lines = ['{"id":1,"a":[{"x":2}]}', "", "  ", '{"id":"no number","a":[]}', '{"id":3,', "not json", '{"id":4,"a":[{"x":null},{"x":5}],"more":1}', "{}"]
    (tmp_path / "x.json").write_text("\n".join(lines) + "\n")
    rows, bad, counts = R.read_nested(spark, str(tmp_path), "id long, a array<struct<x: long>>")
    assert sorted((r.id or 0, [y.x for y in r.a or []]) for r in rows.collect()) == [(0, []), (1, [2]), (4, [None, 5])]
    assert sorted(r.line for r in bad.collect()) == sorted([lines[3], lines[4], lines[5]]) and {r.file for r in bad.collect()} == {"x.json"}
    assert tuple(counts.first()) == (3, 3)


# Personal data.
def test_places_equal_a_search_from_left_to_right(spark):
    texts = ["a@b.co and x a@b.co", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "id x123-45-6789 and 123-45-6789.", "é ü 10.0.0.1 and 310.0.0.1", "born 01/02/1990 GB82WEST12345698765432",
             "call +44 20 7946 0958 or 020-7946-0958", "12 High Street and 5 lane", "", None, "dob: 1/2/90 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [(p.kind, p.start, p.len) for p in r.p] for r in df.select("id", P.locate_pii(F.col("text")).alias("p")).collect()}

    def luhn(d):
        s = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1])))
        return 13 <= len(d) <= 19 and s % 10 == 0

    for i, t in enumerate(texts):
        want = []
        for kind, pattern in P.PATTERNS.items():
            for m in re.finditer(pattern, t or "", re.A):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "credit_card" and not luhn(d):
                    continue
                if kind == "phone" and not (10 <= len(d) <= 15 and d.strip("0") and (re.search(r"[+()\-.\s]", m[0].strip()) or len(d) >= 11)):
                    continue
                want.append((m.start(), kind, len(m[0])))
        assert got[i] == [(k, s, n) for s, k, n in sorted(want)], t


@pytest.mark.parametrize("n", [99, 100, 101])
def test_report_is_cut_and_the_count_is_not(spark, n):
    df = spark.createDataFrame([(i, "me@example.com" if i < n else "nothing", None) for i in range(150)], "id long, a string, b string")
    report, total = P.cell_report(df, "id")
    assert [r.row for r in report.collect()] == list(range(min(n, 100))) and tuple(total.first()) == (n, n)


# Audiences.
def test_gains_over_the_full_cross_product(spark):
    values = {"involvement": ["high", "low", "unknown", None], "age": ["younger", "older", "all"], "gender": ["male", "female", "all"], "education": ["lower", "higher", "all", None]}
    rows = [(i, *v) for i, v in enumerate(itertools.product(*values.values()))]
    df = spark.createDataFrame(rows, "id long, involvement string, age string, gender string, education string")
    got = {r.id: r for r in A.segment_gains(df, "id", A.gain_priors(spark)).collect()}
    offsets = {r.id: r for r in A.audience_offset(df, "id", A.offset_priors(spark)).collect()}
    assert len(got) == len(rows) == len(offsets)
    for i, *spec in rows:
        chosen = dict(zip(values, spec))
        hits = [g for (axis, value, _), g in A.GAINS.items() if chosen[axis] == value]
        gains = {m: min(1.15, max(0.85, math.prod(g.get(m, 1) for g in hits))) for m in A.MODULES}
        assert all(math.isclose(got[i][m], gains[m], abs_tol=1e-9) for m in A.MODULES) and got[i].applied == len(hits)
        assert got[i].max_deviation <= 0.15 + 1e-12 and got[i].neutral == (not hits)
        total = [0.0] * 3
        for (axis, plus, minus), half in A.HALVES.items():
            total = [t + h * ((chosen[axis] == plus) - (chosen[axis] == minus)) for t, h in zip(total, half)]
        assert all(math.isclose(offsets[i][c], t, abs_tol=1e-12) for c, t in zip(("valence", "arousal", "dominance"), total))
        assert offsets[i].perceptible == (max(abs(total[0]) / 1.275, abs(total[1]) / 0.897) >= 0.2)


# Studies.
def responders(rnd):
    """Simulated participants: experts, coin flippers, one inverted, one quick, one who leaves, skippers, one without times."""
    rows = []
    kinds = [("pro", 0.8, True)] * 2 + [("lay", 0.5, False)] * 3 + [("lay", 0.5, None), ("bad", 0.1, False), ("quick", 0.9, True), ("gone", 0.9, False), ("notime", 0.6, False)]
    for k, (kind, right, paid) in enumerate(kinds):
        for item in range(15 if kind == "gone" else 30):
            winner = rnd.randrange(2)
            choice = None if rnd.random() < 0.05 else winner if rnd.random() < right else 1 - winner
            ms = None if kind == "notime" else rnd.randrange(500, 1500) if kind == "quick" else rnd.randrange(2500, 9000)
            rows.append((f"{kind}{k}", paid, item, choice, winner, winner if rnd.random() < 0.7 else 1 - winner, ms))
    return rows


def wilson(k, n):
    p, z = k / n, 1.96
    mid, half = p + z * z / 2 / n, z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    return max(0, (mid - half) / (1 + z * z / n)), min(1, (mid + half) / (1 + z * z / n))


@pytest.mark.parametrize("drop", [(), ("lay2", "lay3", "lay4", "bad6", "notime9")])
def test_whole_study_equals_plain_counts(spark, drop):
    rows = [r for r in responders(random.Random(4)) if r[0] not in drop]
    df = spark.createDataFrame(rows, "participant string, paid boolean, item long, choice int, winner_position int, model_pick int, ms long")
    got = {(r.level, r.participant): r for r in Q.whole_study(df).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    sums, gone = defaultdict(Counter), {}
    for who, own in by.items():
        done = [r for r in own if r[3] is not None]
        times = sorted(r[6] for r in done if r[6] is not None)
        if len(done) < 24:
            gone[who] = "too few answers"
        elif times and times[len(times) // 2] < 2000:
            gone[who] = "too fast"
        else:
            for key in (("participant", who), ("professional" if own[0][1] else "lay", None), ("pooled", None)):
                sums[key]["people"] += 1
                for r in done:
                    human, model = r[3] == r[4], r[5] == r[4]
                    sums[key].update(n=1, h=human, m=model, mo=model and not human, ho=human and not model)
    assert {k: v.reason for k, v in got.items() if k[0] == "excluded"} == {("excluded", w): why for w, why in gone.items()}
    assert {k for k in got if k[0] != "excluded"} == set(sums)
    main = "professional" if sums["lay", None]["people"] >= 3 and sums["professional", None]["n"] else "pooled"
    assert main == ("pooled" if drop else "professional")
    for key, s in sums.items():
        r = got[key]
        assert (r.participants, r.n, r.human_hits, r.model_hits, r.model_only, r.human_only) == (s["people"], s["n"], s["h"], s["m"], s["mo"], s["ho"])
        assert np.allclose((r.lo, r.hi), wilson(s["h"], s["n"])) and np.allclose((r.model_lo, r.model_hi), wilson(s["m"], s["n"]))
        n, k = s["mo"] + s["ho"], min(s["mo"], s["ho"])
        assert math.isclose(r.p_value, min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1, rel_tol=1e-9)
        assert r.primary == (key[0] == main) and r.beats_chance == (r.lo > 0.5)


def test_exclusions_and_chain_of_one_hot_participant(spark):
    rows = [("hot", 1, 100 + i % 7 * 1000) for i in range(5000)] + [("one", 1, None)] * 30 + [("none", None, 5)] * 30
    df = spark.createDataFrame(rows, "participant string, choice int, ms long")
    got = {r.participant: (r.answered, r.mid, r.reason) for r in Q.exclusions(df).collect()}
    assert got == {"hot": (5000, sorted(100 + i % 7 * 1000 for i in range(5000))[2500], None), "one": (30, None, None), "none": (0, None, "too few answers")}
    log = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') as tenant_id", "id as seq", "if(id % 5 = 0, null, concat('p', id)) as payload")
    chain = Q.audit_chain(log)
    assert {tuple(r) for r in Q.verify_chain(chain).collect()} == {("a", 1667, None), ("b", 3333, None)}
    assert {tuple(r) for r in Q.verify_chain(chain.withColumn("payload", F.expr("if(seq = 30, 'edited', payload)"))).collect()} == {("a", 1667, 11), ("b", 3333, None)}
    assert Q.audit_chain(log.where("seq < 0")).count() == 0


# Tenants.
def fit(x, start, penalty=1.0, steps=6):
    w = np.array(start, float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), -(x * p[:, None]).sum(0) + penalty * (w - np.array(start)))
    return w


def test_recalibration_equals_a_fit_for_each_tenant(spark):
    draw, start = np.random.default_rng(2), [0.2, -0.1, 0.4]
    sizes = {"a": 1000, "b": 150, "c": 1, None: 250}
    data = {t: draw.normal(size=(n, 3)) + [0.5, 0, -0.3] for t, n in sizes.items()}
    rows = [(t, *map(float, x)) for t, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "tenant_id string, x double, y double, z double")
    for small in (10_000, 0):  # by broadcast and by a shuffle join
        got = {r.tenant_id: r for r in T.recalibrate(df, ["x", "y", "z"], start, small=small).collect()}
        assert set(got) == set(sizes)
        for t, x in data.items():
            s = max(0, 1 - len(x) / 200)
            own = fit(x, start)
            assert got[t].n == len(x) and math.isclose(got[t].shrinkage, s) and np.allclose(got[t].own, own)
            assert np.allclose(got[t].weights, s * np.array(start) + (1 - s) * own)
    assert T.recalibrate(df.limit(0), ["x"], [0.0]).count() == 0
    score = df.crossJoin(F.broadcast(T.recalibrate(df.where("tenant_id = 'a'"), ["x", "y", "z"], start).select("weights"))).select(T.score_by(F.col("weights"), ["x", "y", "z"]).alias("s"))
    assert score.where("s > 0").count() > len(rows) / 2


def test_tenant_tables_are_pruned_and_audited(spark, tmp_path):
    schema, path = "id long, text string", str(tmp_path / "t")
    a, b = (T.TenantTable(spark, path, t, "user-1", "notes", schema) for t in ("tenant-a", "tenant-b"))
    a.insert(spark.createDataFrame([(1, "one", "tenant-b"), (2, "two", "tenant-b")], f"{schema}, tenant_id string"))  # a claim that does not hold
    b.insert(spark.createDataFrame([(3, "three")], schema))
    assert sorted(r.id for r in a.list().collect()) == [1, 2] and [r.id for r in b.list().collect()] == [3]
    ids = spark.createDataFrame([(1,), (3,), (99,)], "id long")
    assert [tuple(r) for r in a.get(ids).collect()] == [(1, "one", "tenant-a")]
    plan = a._all().where(F.col("tenant_id") == "tenant-a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    log = Counter((r.action, r.tenant_id, r.record_id, r.n) for r in T.audit_log(spark, path).collect())
    assert log == Counter([("insert", "tenant-a", "1", 1), ("insert", "tenant-a", "2", 1), ("insert", "tenant-b", "3", 1), ("read", "tenant-a", None, 2), ("read", "tenant-b", None, 1), ("cross_tenant_denied", "tenant-a", "3", 1)])
    with pytest.raises(ValueError, match="not a tenant id"):
        T.TenantTable(spark, path, "../x", "u", "notes", schema)
    with pytest.raises(ValueError, match="not a tenant id"):
        T.insert_all(spark.createDataFrame([("x/y", 1)], "tenant_id string, id long"), path, "u", "notes")


def test_quiz_responses_of_several_tasks_are_all_read(spark, tmp_path):
    from trialworks.plans import serving

    n = 4000
    docs = spark.range(0, n, 1, 6).selectExpr("id as doc_id", "concat('src', id % 3) as source", "1000 + id as n_chars", "'x' as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, n, 1, 6).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")  # is opened, as its name begins another
    wide = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        got = serving.quiz_responses(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.participant, int(r.item), r.ms) for r in got) == sorted((f"src{i % 3}", i, 1000 + i) for i in range(n))
