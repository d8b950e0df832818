from fractions import Fraction

import numpy as np
import pytest
from tests.llm.test_native import odd, table

from trialworks.llm.mixing import in_mixed_order, mix, pfair_plan


def fluid(v, weights, blocks):
    """Slots that all sources have had when each has had v times its weight, or all its blocks."""
    return sum(min(v * w, n) for w, n in zip(weights, blocks))


def one_run(weights, blocks):
    """(i, k, release, deadline, slot) by earliest deadline first, slot after slot; weights are whole numbers."""
    windows = []
    for w, n in zip(weights, blocks):
        at = [fluid(Fraction(k, w), weights, blocks) for k in range(n + 1)]
        windows.append([(int(a // 1), -int(-b // 1)) for a, b in zip(at, at[1:])])
    done, out = [0] * len(weights), []
    for t in range(sum(blocks)):
        ready = [(windows[i][k][1], i, k, windows[i][k][0]) for i, k in enumerate(done) if k < blocks[i] and windows[i][k][0] <= t]
        deadline, i, k, release = min(ready)
        out.append((i, k, release, deadline, t))
        done[i] += 1
    return out


CASES = [([10 * 19] + [10] * 19, [60] + [8] * 19, 64), ([900] + [1] * 30, [200] + [2] * 30, 2048), ([999, 1], [300, 2], 64), ([1 << 39, 1 << 39, 3], [40, 50, 2], 64), ([1], [33], 2048)]


@pytest.mark.parametrize("weights,blocks,segment", CASES)
def test_segments_equal_one_run_and_stay_within_one_block(spark, weights, blocks, segment):
    sources = spark.createDataFrame([(f"k{i:03}", float(w), n) for i, (w, n) in enumerate(zip(weights, blocks))], "key string, weight double, n long")
    got = sorted((int(p.key[1:]), p.block, p.release, p.deadline, p.slot) for p in pfair_plan(sources, segment).collect())
    assert got == sorted(one_run(weights, blocks))
    done, share, dry = [0] * len(weights), [Fraction(w, sum(weights)) for w in weights], min(Fraction(n, w) for w, n in zip(weights, blocks)) * sum(weights)
    for i, k, release, deadline, t in sorted(got, key=lambda p: p[4]):
        assert k == done[i] and release <= t < deadline
        done[i] += 1
        if t + 1 <= dry:  # no source is used up: the due is the target weight
            assert all(abs(n - (t + 1) * w) < 1 for n, w in zip(done, share))


def test_random_weights_in_small_segments(spark):
    draw = np.random.default_rng(3)
    for _ in range(1):
        weights, blocks = [int(x) for x in draw.integers(1, 1000, 12)], [int(x) for x in draw.integers(1, 40, 12)]
        sources = spark.createDataFrame([(f"k{i:03}", float(w), n) for i, (w, n) in enumerate(zip(weights, blocks))], "key string, weight double, n long")
        got = sorted((int(p.key[1:]), p.block, p.release, p.deadline, p.slot) for p in pfair_plan(sources, 16).collect())
        assert got == sorted(one_run(weights, blocks))


def test_sources_without_weight_come_last_and_lose_nothing(spark):
    sources = spark.createDataFrame([("a", 0.0, 2), ("b", 2.0, 3), ("c", None, 1)], "key string, weight double, n long")
    plan = sorted((p.slot, p.key, p.block) for p in pfair_plan(sources, 4).collect())
    assert [(k, b) for _, k, b in plan] == [("b", 0), ("b", 1), ("b", 2), ("a", 0), ("c", 0), ("a", 1)]
    assert [s for s, *_ in plan] == list(range(6))
    assert pfair_plan(sources.limit(0), 4).collect() == []


def test_mix_keeps_every_row_in_order(spark):
    rows = odd(400)
    got = mix(table(spark, rows), block_size=500, segment=32).collect()
    assert sorted(str(g.doc_id) for g in got) == sorted(str(r[0]) for r in rows)
    assert sum(g["size"] for g in got) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert all(g.release <= g.slot < g.deadline for g in got)
    by_source = {}
    for g in sorted(got, key=lambda g: (g.slot, g.slot_offset)):
        by_source.setdefault(g.source, []).append(g)
    for g in by_source.values():
        assert all(b.block > a.block or b.slot_offset == a.slot_offset + a["size"] for a, b in zip(g, g[1:]))
    assert len({g.slot for g in got}) == len({(g.source, g.block) for g in got})
    even = mix(table(spark, rows), block_size=500, weights=spark.createDataFrame([("s1", 2.0), ("s2", 1.0)], "source string, weight double")).collect()
    assert len(even) == len(got) and mix(table(spark, [])).collect() == []


def test_many_sources_and_a_hot_one(spark):
    many = [(i, "x" * 100, "en", f"m{i % 60}", 1) for i in range(1200)] + [(10_000 + i, "y" * 100, "en", "hot", 1) for i in range(600)]
    got = mix(table(spark, many), block_size=101, segment=512).collect()
    due = 600**0.5 / (600**0.5 + 60 * 20**0.5)
    assert abs(sum(g.source == "hot" and g.slot < 400 for g in got) - 400 * due) < 1


def test_long_texts_clashing_names_and_repeats(spark):
    rows = [(1, "z" * 400_000, "en", "a", 1), (2, "y", "en", "a", 1), (2, "y", "en", "a", 1), (3, None, None, None, None)]
    docs = table(spark, rows).selectExpr("*", "1 as place", "2 as row", "3 as id", "4 as _slot", "5 as key", "6 as block", "7 as size")
    out = in_mixed_order(docs, block_size=1000)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3]
