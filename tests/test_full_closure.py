import math
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from trialworks.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Shipments over seven years, so that a slice of dates holds few of them; parts meet orders in some weeks."""
    d = tmp_path_factory.mktemp("full")
    rows = [(o, (o * 7 + line * 3) % 5 + line, o % 4, line, datetime(1992, 1, 6) + timedelta(weeks=(o // 6) * 9 + line % 2, hours=o)) for o in range(1, 200) for line in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p % 4}") for p in range(20)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return str(d), rows


def brute(rows):
    """row_id -> (least row_id it reaches, time)."""
    def week(t):
        return (t - timedelta(days=t.weekday())).date()

    nodes = {}
    for o, p, _, line, t in rows:
        key = (o, p, week(t))
        i, at = nodes.get(key, (o * 10 + line, t))
        nodes[key] = (min(i, o * 10 + line), min(at, t))
    label = {i: i for i, _ in nodes.values()}
    by = defaultdict(list)
    for (o, p, w), (i, _) in nodes.items():
        by["order", o].append(i)
        by["copy", p, w].append(i)
    changed = True
    while changed:
        changed = False
        for ids in by.values():
            low = min(label[i] for i in ids)
            for i in ids:
                changed |= label[i] != low
                label[i] = low
    return label, dict(nodes.values())


def run(spark, name, d):
    return registry.queries()[name](spark, d).collect()


def test_queries_cover_the_whole_table(spark, tables):
    d, rows = tables
    label, at = brute(rows)
    sizes = Counter(label.values())
    assert len(sizes) > 20 and max(sizes.values()) > 3
    assert {r.row_id: r.group_id for r in run(spark, "leakage_groups_full", d)} == label
    (guard,) = run(spark, "component_guard_full", d)
    assert (guard.groups, guard.n_rows, guard.largest) == (len(sizes), len(label), max(sizes.values()))
    split = {r.row_id: r.split for r in run(spark, "grouped_split_full", d)}
    assert set(split) == set(label) and set(split.values()) == {"train", "val", "test"}
    assert len({(g, split[i]) for i, g in label.items()}) == len(sizes)
    assert {r.rule: r.violations for r in run(spark, "verify_split_full", d)} == {"no split": 0, "group crosses": 0, "copy crosses": 0}
    assert {r.split: r.n_rows for r in run(spark, "split_profile_full", d)} == Counter(split.values())
    taken = {r.row_id: r.group_id for r in run(spark, "group_sample_full", d)}
    assert len(taken) >= 200 and all(sum(g == h for h in taken.values()) == sizes[g] for g in taken.values())
    early = {r.row_id for r in run(spark, "temporal_split_full", d) if r.early}
    assert early == set(sorted(at, key=lambda i: (at[i], i))[: math.floor(0.6 * len(at))])


def test_guard_over_one_large_group(spark, tables):
    (guard,) = run(spark, "component_guard_abort", tables[0])
    assert guard.share > 0.2 and not guard.passed


def test_components_are_sought_among_experiments_that_share_a_copy(spark, monkeypatch):
    from trialworks.operators import splits as G

    seen = []
    sought = G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda edges, *a: seen.append(edges.count()) or sought(edges, *a))
    rows = [(10 * t + k, t, f"copy {t}.{k}") for t in range(50) for k in range(4)]
    rows += [(900, 3, "Shared"), (901, 7, "shared"), (902, 7, "more"), (903, 41, "more"), (904, 8, None), (905, 9, None), (906, None, "x"), (907, None, "y")]
    rows += [(908, 11, "p"), (908, 12, "q"), (None, 20, "lone"), (None, 21, "lone")]  # an id of two rows links them; a row without one does not
    got = G.leakage_groups(spark.createDataFrame(rows, "row_id long, test_id long, copy_text string")).collect()
    label = {r: r for r, _, _ in rows if r is not None}
    for _ in range(9):
        for key in (lambda r: ("t", r[1]), lambda r: ("c", (r[2] or "").lower())):
            least = {}
            for r in rows:
                if r[0] is not None:
                    least[key(r)] = min(label[r[0]], least.get(key(r), label[r[0]]))
            for r in rows:
                if r[0] is not None:
                    label[r[0]] = min(label[r[0]], least[key(r)])
    assert len(got) == len(rows)
    assert all(r.group_id == (None if r.row_id is None else label[r.row_id]) for r in got)
    assert seen[0] < 10  # not an edge or two a row
