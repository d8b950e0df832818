import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.functions import text as X
from trialworks.operators import duplicates as D
from trialworks.operators import effects as E
from trialworks.operators import privacy as P
from trialworks.operators import ranks as R
from trialworks.operators import reposts
from trialworks.operators import splits as G


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [0.5] * 1000 + [1.5], [random.Random(1).gauss(0, 1) for _ in range(999)] + [None] * 5])
def test_quantiles_and_ranks_equal_a_sort(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known, shares = sorted(v for v in values if v is not None), [0.0, 0.1, 0.5, 0.77, 1.0]
    got = R.quantiles(df, "x", shares)
    assert np.allclose(got, np.quantile(known, shares)) if known else got == [None] * 5
    assert R.values_at(df, "x", [-1, 0, 1, len(known) // 10, len(known)]) == {r: known[r] for r in {0, 1, len(known) // 10} if r < len(known)}


def test_pairs_beyond_the_budget_are_an_error(spark):
    arms = spark.createDataFrame([(t, f"a{i}", f"copy {i}", float(i), 1.0, [float(i // 2)]) for t in (1, 2) for i in range(5 if t == 1 else 20)], "test_id long, arm_id string, copy_text string, target double, weight double, v array<double>")
    assert E.build_pairs(arms, most=190).count() == 10 + 190
    with pytest.raises(Exception, match="too many pairs for 2"):
        E.build_pairs(arms, most=189).count()
    assert E.build_pairs(arms.where("test_id = 1"), most=10).count() == 10
    assert E.build_pairs(arms, vector="v").count() == (10 - 2) + (190 - 10)  # neighbours with equal vectors are left out


def test_stratified_split_equals_plain_lists(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice(["x", "x", "x", "y", None])) for g in range(400) for _ in range(rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, "group_id long, source string")
    got = {r.group_id: r.split for r in G.stratified_split(df, "source").collect()}
    import hashlib

    by = defaultdict(Counter)
    for g, s in rows:
        by[g][s] += 1
    strata = defaultdict(list)
    for g, n in by.items():
        strata[min(n, key=lambda s: (-n[s], s is not None, s or ""))].append(g)
    for own in strata.values():
        own.sort(key=lambda g: (hashlib.md5(f"{g}:7".encode()).hexdigest(), g))
        half_up = lambda x: int(x + 0.5)
        a = half_up(len(own) * 0.7)
        b = a + half_up(len(own) * 0.15)
        assert [got[g] for g in own] == ["train"] * a + ["val"] * (b - a) + ["test"] * (len(own) - b)


def test_temporal_split_cuts_inside_an_instant(spark):
    rows = [(i, f"2024-01-0{1 + (i > 20) + (i > 90)} 00:00:00") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, t string").select("row_id", F.col("t").cast("timestamp").alias("created_at"))
    for share in (0.0, 0.21, 0.6, 0.91, 1.0):
        got = {r.row_id for r in G.temporal_split(df, share).collect() if r.early}
        assert got == set(range(int(100 * share)))


def test_best_two_posts_of_a_link(spark):
    rows = [("a", "t1", 5), ("a", "t2", 5), ("a", "t2", 1), ("b", "t1", 9), ("b", "t2", 2), ("c", "t1", 100), ("d", "t1", 3), ("d", "t1", 1)]
    (r,) = reposts.repost_yield(spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "url string, title string, points long, id long")).collect()
    assert (r.urls, r.reposted, r.retitled, r.ten_points, r.median_gap, r.mean_gap, r.max_gap) == (4, 3, 2, 1, 3.5, 3.5, 7)


def test_clusters_reports_and_collapse(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefghij ") for _ in range(300)) for _ in range(6)]
    rows = [(i, base[i % 6] if i < 14 else "".join(draw.choice("klmnopqrst ") for _ in range(300)), f"s{i % 3}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    label = {i: i % 6 if i < 14 else i for i, _, _ in rows}
    clusters = D.near_duplicate_clusters(docs)
    assert {r.id: r.component for r in clusters.collect()} == label
    sizes = Counter(label.values())
    (r,) = D.cluster_report(clusters).collect()
    assert (r.clusters, r.singletons, r.multi, r.rows_in_multi, r.largest) == (12, 6, 6, 14, 3) and max(sizes.values()) == 3
    got = {r.source: (r.n, r.clusters, round(r.collapse, 9)) for r in D.source_collapse(clusters.join(docs.select(F.col("doc_id").alias("id"), "source"), "id")).collect()}
    for s in ("s0", "s1", "s2"):
        own = [label[i] for i, _, x in rows if x == s]
        assert got[s] == (len(own), len(set(own)), round(1 - len(set(own)) / len(own), 9))


TEXTS = ["She told Anna that he went home. They said nothing.", "Many people left. All Workers and Anna Smith walked, and Bob built it.", "", "Hello World", "one two three", "Then Paris. Then New York! and Rome? \n Berlin", "he he he him walked talked jumped", "É Anna Über Maria went", "citizens of all nations kept most groups"]


def test_narrative_features_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in docs.select("doc_id", *[c.alias(k) for k, c in X.narrative(F.col("text")).items()]).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall("[a-z][a-z'-]*", t.lower())
        n = max(len(w), 1)
        third, many = sum(x in X.THIRD_SINGULAR for x in w), sum(x in X.COLLECTIVE for x in w)
        past = sum(x in X.PAST_IRREGULAR or re.fullmatch("[a-z]+ed", x) is not None for x in w)
        caps = sum(1 for m in re.finditer(r"\b[A-Z][a-z]{2,}\b", t) if m.start() and not re.fullmatch(r"[.!?]\s", t[max(0, m.start() - 2) : m.start()]))
        two = lambda c: min(c, 2) / 2
        want = {"third_singular_frac": third / n, "collective_frac": many / n, "individual_minus_collective": (third - many) / n, "has_individual_agent": float(third > 0), "past_tense_frac": past / n,
                "narrative_score": 0.5 * two(third) + 0.3 * two(past) + 0.2 * (caps > 0), "midcap_count": float(caps), "specific_referent_score": (third > 0) + two(caps) - two(many)}
        assert all(abs(got[i][k] - v) < 1e-9 for k, v in want.items()), (t, got[i], want)


def test_kinds_count_what_is_located(spark):
    texts = ["a@b.co x@y.org 10.0.0.1", "4111 1111 1111 1111", "no data", None, "born 1/2/1990, DOB: 3.4.91"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", P.scan_pii(F.col("text")).alias("k"), P.locate_pii(F.col("text")).alias("p")).collect()
    for r in rows:
        assert {x.kind: x["count"] for x in r.k} == dict(Counter(x.kind for x in r.p))
