import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few experiments of different sizes, one of a single arm, as the tables that the queries read."""
    draw, d = np.random.default_rng(5), str(tmp_path_factory.mktemp("pair-tables"))
    names, rows = [f"copy {i}" for i in range(14)], []
    for supplier, arms in ((1, 14), (2, 9), (3, 2), (4, 1), (7, 12)):
        for part in range(arms):
            for _ in range(int(draw.integers(3, 12))):
                rows.append((len(rows), part, supplier, int(draw.integers(1, 8)), float(draw.integers(10, 50)), str(draw.choice(["R", "N"])), str(draw.choice(["O", "F"])), int(draw.integers(9000, 9900))))
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, day int")
    lineitem.selectExpr("* except (day)", "timestamp_seconds(day * 86400L) as l_shipdate").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def both(spark, d, name):
    """Rows of the query and of its SQL, numbers to nine places."""
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, d)
    plain = lambda row: tuple(round(float(v), 9) if isinstance(v, (int, float)) else v for v in row)
    want = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in found.columns]
    return sorted(plain(r) for r in found.collect()), sorted(plain([r[i] for i in at]) for r in want.fetchall())


def test_allocate_makes_all_draws_of_its_contract(spark, tables):
    got, want = both(spark, tables, "allocate")
    assert got == want
    assert any(round(share * 2000) % 10 for _, _, share in got)  # shares of 200 draws are multiples of ten


def test_should_stop_keeps_its_sql(spark, tables):
    got, want = both(spark, tables, "should_stop")
    assert got == want


QUERIES = ["seed_summary", "paired_seed_diff", "noise_floor", "paired_diff", "paired_bootstrap", "disagreement_quadrants", "flip_rate", "accuracy_at_coverage", "fit_tiers", "declined_accuracy", "top_disagreements"]


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_are_neither_moved_nor_written(spark, tables, name, monkeypatch):
    from trialworks.operators import diagnostics, evaluate, ranks
    from trialworks.plans import diagnostics as plans
    from trialworks.plans import registry
    from trialworks.storage import written

    sizes = []

    def seen(df, *a, **kw):
        sizes.append(df.count())
        return written(df, *a, **kw)

    for module in (diagnostics, evaluate, ranks, plans, registry):
        monkeypatch.setattr(module, "written", seen, raising=False)
    if name != "noise_floor":  # its check refuses the baseline of so few arms
        got, want = both(spark, tables, name)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert all(x == pytest.approx(y, abs=1e-8) for x, y in zip(g, w))
        assert sizes and max(sizes) < 40  # of arms there are 37, of pairs some 200
    pairs = registry.scored(spark, tables) if name not in QUERIES[:3] else plans.seed_pairs(spark, tables, a=(2.5, [1, 2]))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the arms of an experiment with each other


@pytest.mark.parametrize("bins", [1, 7, 65_536])
def test_narrowed_quantiles_are_exact(spark, bins):
    from trialworks.operators import ranks as R

    draw = np.random.default_rng(3)
    values = [*map(float, np.round(draw.normal(size=300), 1)), *[0.5] * 40, 1e9, -1e-9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double")
    shares = [0.0, 0.25, 0.5, 0.731, 0.9, 1.0]
    assert R.narrowed_quantiles(df, "x", shares, bins) == R.quantiles(df, "x", shares)
    assert R.narrowed_quantiles(df, "x", shares, bins) == pytest.approx(list(np.quantile(values, shares)))
    assert R.narrowed_quantiles(df.where("x is null"), "x", shares, bins) == [None] * 6
    assert R.narrowed_quantiles(df.where("x = 0.5"), "x", shares, bins) == [0.5] * 6
    assert R.narrowed_quantiles(spark.createDataFrame([(float("inf"),), (1.0,)], "x double"), "x", [0.0], bins) == [1.0]
