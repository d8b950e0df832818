import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from trialworks.operators.ranking import allocate, should_stop
from trialworks.streaming import batches as B
from trialworks.streaming import decisions as D
from trialworks.streaming import jobs as J

EVENT = "ts timestamp, test_id long, arm long, impressions long, clicks long"
T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def contrasts(rows, width, slide, closed):
    """By plain loops: windows that have ended by ``closed``."""
    sums = {}
    for ts, test, arm, n, c in rows:
        h = (ts - T0).total_seconds() / 3600
        k = math.floor(h / slide)
        while k * slide + width > h:
            a = sums.setdefault((k * slide, test), {}).setdefault(arm, [0, 0])
            a[0] += n
            a[1] += c
            k -= 1
    out = []
    lo = lambda c, n: math.log((c + 0.5) / (n - c + 0.5))
    for (start, test), arms in sums.items():
        n, c = sum(a[0] for a in arms.values()), sum(a[1] for a in arms.values())
        if start + width <= closed and n > 0 and c > 0 and len(arms) > 1:
            out += [(start, test, arm, a[0], a[1], round(lo(a[1], a[0]) - lo(c, n), 9)) for arm, a in arms.items()]
    return sorted(out)


def test_contrast_by_sliding_window_with_late_rows_to_the_side(spark, tmp_path):
    rows = [(at(h), h % 2, h % 3, 10 + h, 1 + h % 4) for h in range(40)]
    put(spark, tmp_path / "in", rows, EVENT)
    put(spark, tmp_path / "in", [(at(60), 1, 1, 5, 1)], EVENT)
    late = [(at(2), 0, 0, 1000, 900), (at(57), 1, 2, 7, 2)]  # the first one's windows have closed
    put(spark, tmp_path / "in", late, EVENT)
    path = str(tmp_path / "routed")
    query, schema = D.route_late(source(spark, tmp_path / "in", EVENT), path, slide_s=6 * 3600)
    query.awaitTermination()
    counts = B.committed(spark, path, "counts", "on_time long, late long, latest long").agg(F.sum("on_time"), F.sum("late")).first()
    assert tuple(counts) == (42, 1)
    assert [r.clicks for r in B.committed(spark, path, "late", schema).collect()] == [900]
    log = spark.readStream.schema(schema + ", epoch long").option("basePath", f"{path}/on_time").parquet(f"{path}/on_time").drop("epoch")
    out = J.settled(D.windowed_contrast(log, width="12 hours", slide="6 hours"), "contrast").collect()
    got = sorted(((r.start - T0).total_seconds() / 3600, r.test_id, r.arm, r.impressions, r.clicks, round(r.target, 9)) for r in out)
    assert got == contrasts([r for r in rows + [(at(60), 1, 1, 5, 1), late[1]]], 12, 6, 59) and len(got) > 10


def test_decisions_equal_the_final_counters_and_latch(spark, tmp_path):
    first = [(T0, 1, 0, 1000, 10), (T0, 1, 1, 1000, 400), (T0, 2, 0, 50, 5), (T0, 2, 1, 50, 5)]
    put(spark, tmp_path / "in", first, EVENT)
    path = str(tmp_path / "out")

    def run():
        D.decide(J.arm_counters(source(spark, tmp_path / "in", EVENT)), path, draws=200).awaitTermination()

    run()
    assert sorted(map(tuple, D.decided(spark, path).collect())) == [(1, 1, 0), (2, None, None)]
    put(spark, tmp_path / "in", [(T0, 1, 0, 100_000, 60_000), (T0, 3, 0, 10, 1)], EVENT)  # now arm 0 leads
    run()
    got = sorted(map(tuple, D.decided(spark, path).collect()))
    assert got[0] == (1, 1, 0) and got[1] == (2, None, None)  # the winner once found stays
    totals = spark.createDataFrame([(1, 0, 101_000, 60_010), (1, 1, 1000, 400), (2, 0, 50, 5), (2, 1, 50, 5), (3, 0, 10, 1)], "test_id long, arm_id long, impressions long, clicks long")
    want = sorted((r.test_id, r.arm_id, r.share) for r in allocate(totals, 200).collect())
    assert sorted(map(tuple, D.allocation(spark, path).collect())) == want
    assert should_stop(allocate(totals, 200)).where("test_id = 1").first().winner == 0
    changed = {r.test_id for r in B.committed(spark, path, "decisions", "test_id long, winner long, since long").where("epoch = 1").collect()}
    assert changed == {1, 3}  # only changed experiments are looked at


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    put(spark, tmp_path / "in", [(T0, 1, 0, 1000, 10), (T0, 1, 1, 1000, 400)], EVENT)
    path = str(tmp_path / "out")
    for checkpoint in ("a", "b"):  # another checkpoint repeats the trigger of number 0
        q = D.decide(J.arm_counters(source(spark, tmp_path / "in", EVENT)), path, draws=100)
        q.awaitTermination()
        (tmp_path / "out" / "checkpoint").rename(tmp_path / checkpoint)
    assert sorted(map(tuple, D.decided(spark, path).collect())) == [(1, 1, 0)]
    assert B.committed(spark, path, "counters", D.COUNTERS).count() == 2


OUTCOME = "id long, actual int, resolved_at timestamp"


def test_outcomes_expire_and_are_swept_once(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, 0, at(0)), (1, 1, at(1)), (2, 1, at(24))], OUTCOME)
    put(spark, tmp_path / "in", [(1, 1, at(48)), (3, 0, at(50))], OUTCOME)  # 1 is still kept
    put(spark, tmp_path / "in", [(4, 0, at(24 * 40))], OUTCOME)  # the watermark passes the others' periods
    put(spark, tmp_path / "in", [(1, 1, at(24 * 41))], OUTCOME)  # a first one again
    with D.on_rocksdb(spark):
        out = J.settled(D.expiring_outcomes(source(spark, tmp_path / "in", OUTCOME)), "expiring").collect()
    got = sorted((r.id, r.kind, r.actual) for r in out)
    assert got == [(1, "accepted", 0), (1, "accepted", 1), (1, "rejected", 1), (1, "rejected", 1), (1, "swept", 0), (2, "accepted", 1), (2, "swept", 1), (3, "accepted", 0), (3, "swept", 0), (4, "accepted", 0)]


def test_quarantine_that_fails_between_its_sinks(spark, tmp_path, monkeypatch):
    schema = "id long, text string"
    put(spark, tmp_path / "in", [(1, "hello"), (2, "mail me@example.com"), (3, None)], schema)
    path, real = str(tmp_path / "out"), D.commit

    def broken(p, epoch, tables):
        tables["clean"].write.mode("overwrite").parquet(f"{p}/clean/epoch={epoch}")
        raise OSError("lost between the sinks")

    monkeypatch.setattr(D, "commit", broken)
    with pytest.raises(Exception, match="lost between"):
        D.quarantine_stream(source(spark, tmp_path / "in", schema), "text", path).awaitTermination()
    assert B.committed(spark, path, "clean", schema).count() == 0  # half a trigger does not count
    monkeypatch.setattr(D, "commit", real)
    D.quarantine_stream(source(spark, tmp_path / "in", schema), "text", path).awaitTermination()
    assert sorted(r.id for r in B.committed(spark, path, "clean", schema).collect()) == [1, 3]
    assert [tuple(r) for r in B.committed(spark, path, "held", "id long").collect()] == [(2, 0)]


def test_ingest_cut_off_between_files_ends_with_the_same_rows(spark, tmp_path, monkeypatch):
    schema = "id long, x long"
    put(spark, tmp_path / "in", [(1, 1), (2, 1), (2, 1)], schema)
    put(spark, tmp_path / "in", [(2, 2), (3, 2), (None, 2)], schema)
    path, real, calls = str(tmp_path / "out"), D.commit, []

    def second_fails(p, epoch, tables):
        calls.append(epoch)
        if len(calls) == 2:
            tables["rows"].write.mode("overwrite").parquet(f"{p}/rows/epoch={epoch}")
            raise OSError("killed")
        real(p, epoch, tables)

    monkeypatch.setattr(D, "commit", second_fails)
    with pytest.raises(Exception, match="killed"):
        D.ingest_stream(source(spark, tmp_path / "in", schema), path, "id").awaitTermination()
    assert B.committed(spark, path, "rows", schema).count() < 3
    D.ingest_stream(source(spark, tmp_path / "in", schema), path, "id").awaitTermination()
    assert sorted(r.id for r in B.committed(spark, path, "rows", schema).collect()) == [1, 2, 3]


def test_outcomes_by_trigger_are_those_kept_by_state(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, 0, at(0)), (1, 1, at(1)), (2, 1, at(24)), (None, 1, at(25)), (5, 1, at(30)), (5, 0, at(30))], OUTCOME)
    put(spark, tmp_path / "in", [(1, 1, at(48)), (3, 0, at(50)), (None, 0, at(51))], OUTCOME)
    put(spark, tmp_path / "in", [(4, 0, at(24 * 40))], OUTCOME)  # the watermark passes the others' periods
    put(spark, tmp_path / "in", [(1, 1, at(24 * 41))], OUTCOME)  # a first one again
    kept, once = str(tmp_path / "kept"), str(tmp_path / "once")
    for _ in range(2):  # the second start finds nothing new
        D.kept_outcomes(source(spark, tmp_path / "in", OUTCOME), kept).awaitTermination()
        D.first_outcomes(source(spark, tmp_path / "in", OUTCOME), once).awaitTermination()
    got = sorted((r.id or 0, r.kind, r.actual) for r in B.committed(spark, kept, "outcomes", D.KINDS).collect())
    want = [(0, "accepted", 1), (0, "rejected", 0), (0, "swept", 1), (1, "accepted", 0), (1, "accepted", 1), (1, "rejected", 1), (1, "rejected", 1), (1, "swept", 0), (2, "accepted", 1), (2, "swept", 1)]
    assert got == want + [(3, "accepted", 0), (3, "swept", 0), (4, "accepted", 0), (5, "accepted", 0), (5, "rejected", 1), (5, "swept", 0)]
    got = sorted((r.id or 0, r.accepted, r.actual) for r in B.committed(spark, once, "outcomes", D.ONCE).collect())
    assert got == [(0, False, 0), (0, True, 1), (1, False, 1), (1, False, 1), (1, False, 1), (1, True, 0), (2, True, 1), (3, True, 0), (4, True, 0), (5, False, 1), (5, True, 0)]
