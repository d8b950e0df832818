"""Streams that decide: contrasts by window, allocation and stopping, outcomes that expire, checked and resumable loads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trialworks.functions import stats as S
from trialworks.operators.privacy import quarantine
from trialworks.operators.ranking import allocate, should_stop
from trialworks.storage import remove, written
from trialworks.streaming.batches import commit, committed, done

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTERS = "test_id long, arm long, impressions long, clicks long"


def windowed_contrast(events: DataFrame, time: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, test_id, arm, impressions, clicks, target): log-odds of each arm less its experiment's, by (sliding) window.

    Two stateful aggregations in a row: sums by arm, then by experiment over the same window, both with partial sums before
    the shuffle. In append mode a window's rows come once, when the watermark has passed its end, and its state goes.
    """
    w = F.window(time, width, slide)
    arms = events.withWatermark(time, late).groupBy(w.alias("w"), "test_id", "arm").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    tests = arms.groupBy("w", "test_id").agg(F.sum("impressions").alias("all_impressions"), F.sum("clicks").alias("all_clicks"), F.collect_list(F.struct("arm", "impressions", "clicks")).alias("arms"))
    rows = tests.where("all_impressions > 0 and all_clicks > 0 and size(arms) > 1").select(F.col("w.start").alias("start"), "test_id", "all_impressions", "all_clicks", F.explode("arms").alias("a"))
    rows = rows.select("start", "test_id", "a.arm", "a.impressions", "a.clicks", "all_impressions", "all_clicks")
    pool = S.logit(S.smoothed_rate("all_clicks", "all_impressions"))
    return rows.withColumn("target", S.logit(S.smoothed_rate("clicks", "impressions")) - pool).drop("all_impressions", "all_clicks")


def route_late(stream: DataFrame, path: str, time: str = "ts", slide_s: int = 86_400, late_s: int = 3600):
    """Sends events to ``path``/on_time or ``path``/late, one folder a trigger, and counts both in ``path``/counts.

    An event is late when a window that holds it has closed: its next multiple of ``slide_s`` is not after the latest time of
    all earlier triggers less ``late_s``. A stream with that watermark over the events on time drops none of them, however
    its own triggers fall.
    """
    schema = stream.schema.toDDL()
    end = (F.floor(F.unix_micros(time) / F.lit(slide_s * 1_000_000)) + 1) * F.lit(slide_s * 1_000_000)

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = committed(spark, path, "counts", "on_time long, late long, latest long", epoch).agg(F.max("latest")).first()[0]
        batch = batch.withColumn("__late", F.coalesce(end <= F.lit(None if seen is None else seen - late_s * 1_000_000).cast("long"), F.lit(False)))
        counts = batch.agg(F.count_if(~F.col("__late")).alias("on_time"), F.count_if("__late").alias("late"), F.max(F.unix_micros(time)).alias("latest"))
        commit(path, epoch, {"on_time": batch.where("not __late").drop("__late"), "late": batch.where("__late").drop("__late"), "counts": counts})

    return stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start(), schema


def _latest(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Counters of all arms as of the triggers before, from the last whole table and the changes since."""
    changes = committed(spark, path, "counters", COUNTERS, before)
    keys = ["test_id", "arm"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct("impressions", "clicks"), "epoch").alias("x")).select(*keys, "x.impressions", "x.clicks")


def decide(counters: DataFrame, path: str, confidence: float = 0.95, draws: int = 2000, **options):
    """Allocation and stopping for a stream of counters (test_id, arm, impressions, clicks; update mode).

    Each trigger looks at the experiments whose counters changed and at no other: it adds the counters of their other arms
    from earlier triggers, allocates traffic and asks whether to stop. An experiment that once stopped keeps its winner
    and the trigger that found it, whatever comes later. A repeated trigger writes the same folders again.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        changed = batch.select(*[F.col(c).cast("long").alias(c) for c in ("test_id", "arm", "impressions", "clicks")]).persist()
        try:
            tests = changed.select("test_id").distinct()
            others = _latest(spark, path, epoch).join(tests, "test_id", "left_semi").join(changed, ["test_id", "arm"], "left_anti")
            now = changed.unionByName(others).withColumnRenamed("arm", "arm_id")
            shares = allocate(now, draws, **options).persist()
            found = should_stop(shares, confidence).select("test_id", F.col("winner").alias("found"))
            old = committed(spark, path, "decisions", "test_id long, winner long, since long", epoch).where("winner is not null")
            old = old.groupBy("test_id").agg(F.min_by(F.struct("winner", "since"), "epoch").alias("old"))
            out = found.join(old, "test_id", "left").select(
                "test_id", F.coalesce("old.winner", "found").alias("winner"), F.when(F.coalesce("old.winner", "found").isNotNull(), F.coalesce("old.since", F.lit(epoch).cast("long"))).alias("since"))
            commit(path, epoch, {"counters": changed, "shares": shares.withColumnRenamed("arm_id", "arm"), "decisions": out})
            shares.unpersist()
        finally:
            changed.unpersist()

    return counters.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, winner, since): each experiment's latest decision; null winner while it runs."""
    rows = committed(spark, path, "decisions", "test_id long, winner long, since long")
    return rows.groupBy("test_id").agg(F.max_by(F.struct("winner", "since"), "epoch").alias("x")).select("test_id", "x.winner", "x.since")


def allocation(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, arm, share): each experiment's latest allocation."""
    rows = committed(spark, path, "shares", "test_id long, arm long, share double")
    last = rows.groupBy("test_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["test_id", "epoch"]).select("test_id", "arm", "share")


class _Expiring(StatefulProcessor):
    """Keeps the first outcome of a key for a period, rejects others meanwhile, and tells once that it is swept."""

    def __init__(self, period_ms: int):
        self.period_ms = period_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "actual int, resolved_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        if self.first.exists() and self.first.get()[1] + self.period_ms <= timerValues.getCurrentWatermarkInMs():
            self.handle.deleteTimer(self.first.get()[1] + self.period_ms)  # rows come before the timers of their trigger
            yield from self.handleExpiredTimer(key, timerValues, None)
        d = pd.concat(list(rows)).sort_values(["resolved_ms", "actual"], kind="stable")
        kinds = ["rejected"] * len(d)
        if not self.first.exists() and len(d):
            ms = int(d["resolved_ms"].iloc[0])
            self.first.update((int(d["actual"].iloc[0]), ms))
            self.handle.registerTimer(ms + self.period_ms)
            kinds[0] = "accepted"
        yield pd.DataFrame({"id": d["id"], "actual": d["actual"].astype("int32"), "kind": kinds})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        actual = self.first.get()[0]
        self.first.clear()
        yield pd.DataFrame({"id": pd.Series([key[0]], dtype="int64"), "actual": pd.Series([actual], dtype="int32"), "kind": ["swept"]})

    def close(self) -> None:
        pass


def expiring_outcomes(outcomes: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(id, actual, kind) of outcomes (id, actual, resolved_at): accepted, rejected, and swept once its period is over.

    The first outcome of a prediction is accepted and later ones are rejected as long as it is kept: until the watermark
    passes its time and ``days``. Then a timer ends it, so the state holds no more than the period brings. An outcome that
    comes after that is a first one again. First is the earliest of its trigger, ties to the smaller value.
    """
    o = outcomes.select(F.col("id").cast("long").alias("id"), F.col("actual").cast("int").alias("actual"), "resolved_at", F.unix_millis("resolved_at").alias("resolved_ms")).withWatermark("resolved_at", late)
    return o.groupBy("id").transformWithStateInPandas(_Expiring(days * 86_400_000), "id long, actual int, kind string", "append", "EventTime")


def _firsts(batch: DataFrame, kept: DataFrame, time: str) -> DataFrame:
    """A trigger's rows with first: the earliest of an id that is not in ``kept``, ties to the smaller value, nulls last."""
    w = Window.partitionBy("id").orderBy(F.asc_nulls_last(time), F.asc_nulls_last("actual"))
    there = kept.select(F.col("id").alias("there"), F.lit(True).alias("known"))
    rows = batch.withColumn("k", F.row_number().over(w)).join(there, F.col("id").eqNullSafe(F.col("there")), "left")
    return rows.withColumn("first", (F.col("k") == 1) & F.col("known").isNull()).drop("k", "there", "known")


ONCE = "id long, actual int, accepted boolean"


def first_outcomes(outcomes: DataFrame, path: str):
    """What :func:`jobs.write_once` tells, for triggers that bring many predictions: each is one sort and one join with what
    earlier triggers accepted, instead of a call of Python per prediction. Rows (ONCE) are in ``path``/outcomes."""

    def sink(batch: DataFrame, epoch: int) -> None:
        o = batch.select(F.col("id").cast("long").alias("id"), F.col("actual").cast("int").alias("actual"), "resolved_at")
        kept = committed(batch.sparkSession, path, "outcomes", ONCE, epoch).where("accepted")
        commit(path, epoch, {"outcomes": _firsts(o, kept, "resolved_at").select("id", "actual", F.col("first").alias("accepted"))})

    return outcomes.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()


KEPT, KINDS = "id long, actual int, resolved_ms long", "id long, actual int, kind string"


def kept_outcomes(outcomes: DataFrame, path: str, days: int = 30, late_s: int = 86_400):
    """What :func:`expiring_outcomes` tells, for triggers that bring many predictions: each is a sort and a join with the
    outcomes kept, which it writes anew, so they are those of the period and no more. Rows (KINDS) are in ``path``/outcomes.

    A trigger ends by sweeping those whose period the latest time of all rows so far, less ``late_s``, has passed. A row
    that comes late is not dropped: it is rejected, or, where nothing is kept, accepted and swept as any other.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        o = batch.select(F.col("id").cast("long").alias("id"), F.col("actual").cast("int").alias("actual"), F.unix_millis(F.col("resolved_at").cast("timestamp")).alias("resolved_ms"))
        last = max(done(spark, path, epoch), default=-1)
        kept = committed(spark, path, "kept", KEPT, epoch).where(F.col("epoch") == last).drop("epoch")
        rows = written(_firsts(o, kept, "resolved_ms"), "outcomes")
        times = [t for t in (rows.agg(F.max("resolved_ms")).first()[0], committed(spark, path, "latest", "latest long", epoch).agg(F.max("latest")).first()[0]) if t is not None]
        latest = max(times, default=None)
        state = kept.unionByName(rows.where("first").select("id", "actual", "resolved_ms"))
        over = F.coalesce(F.col("resolved_ms") + days * 86_400_000 <= F.lit(None if latest is None else latest - late_s * 1000).cast("long"), F.lit(False))
        told = rows.select("id", "actual", F.when(F.col("first"), "accepted").otherwise("rejected").alias("kind"))
        swept = state.where(over).select("id", "actual", F.lit("swept").alias("kind"))
        commit(path, epoch, {"outcomes": told.unionByName(swept), "kept": state.where(~over), "latest": spark.range(1).select(F.lit(latest).cast("long").alias("latest"))})
        remove(rows)

    return outcomes.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()


class on_rocksdb:
    """For ``with``: streams that start inside keep their state in RocksDB, which state with timers needs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before) if self.before else self.spark.conf.unset(self.KEY)


def quarantine_stream(stream: DataFrame, text: str, path: str):
    """Rows without personal data to ``path``/clean, the others, text withheld, to ``path``/held, both or neither of a trigger."""

    def sink(batch: DataFrame, epoch: int) -> None:
        clean, held = quarantine(batch, text)
        commit(path, epoch, {"clean": clean, "held": held.drop(text)})

    return stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()


def ingest_stream(files: DataFrame, path: str, key: str):
    """Loads the rows of a file source whose key is not there yet; a load that was cut off is loaded again, none twice.

    The checkpoint tells which files a trigger takes, its mark that the load is whole.
    """
    schema = files.schema.toDDL()

    def sink(batch: DataFrame, epoch: int) -> None:
        there = committed(batch.sparkSession, path, "rows", schema, epoch).select(key)
        commit(path, epoch, {"rows": batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(there, key, "left_anti").select(*files.columns)})

    return files.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
