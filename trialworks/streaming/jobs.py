"""Structured Streaming jobs over growing logs: counters, windows, outcomes, dedup. Those that decide are in :mod:`decisions`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialworks.operators.privacy import apply_retention
from trialworks.operators.study import track_record
from trialworks.storage import shared_dir


def arm_counters(events: DataFrame) -> DataFrame:
    """Running impressions and clicks of every arm (update or complete mode)."""
    return events.groupBy("test_id", "arm").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))


def windowed_rates(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Impressions, clicks and rate per experiment and tumbling window; rows later than the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "test_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return w.select(F.col("w.start").alias("start"), "test_id", "impressions", "clicks", (F.col("clicks") / F.col("impressions")).alias("ctr"))


def resolved(predictions: DataFrame, outcomes: DataFrame, within: str = "30 days") -> DataFrame:
    """Predictions joined with outcomes that follow their seal, within a bounded time so that state can be dropped."""
    p = predictions.withWatermark("sealed_at", within).alias("p")
    o = outcomes.withWatermark("resolved_at", within).alias("o")
    return p.join(o, F.expr(f"p.id = o.prediction_id and o.resolved_at > p.sealed_at and o.resolved_at <= p.sealed_at + interval {within}"))


def first_sight(rows: DataFrame, key: str = "id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, the first time it is seen; state is kept for the watermark only."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_once(outcomes: DataFrame) -> DataFrame:
    """(id, actual, accepted): the first outcome of a prediction is accepted, later ones are returned as rejected.

    First is the earliest of the trigger that brings a prediction's first outcome, ties to the smaller value; what was
    accepted in an earlier trigger stays. To be write-once for good, an accepted value is kept without end.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def keep(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["resolved_at", "actual"], kind="stable")  # one prediction's, of one trigger
        accepted = [False] * len(rows)
        if not state.exists and len(rows):
            state.update((int(rows["actual"].iloc[0]),))
            accepted[0] = True
        yield pd.DataFrame({"id": rows["id"], "actual": rows["actual"], "accepted": accepted})

    return outcomes.groupBy("id").applyInPandasWithState(keep, "id long, actual int, accepted boolean", "first int", "append", GroupStateTimeout.NoTimeout)


def chained(entries: DataFrame) -> DataFrame:
    """(tenant_id, seq, payload, prev_hash, hash): appends arriving entries to their tenant's audit chain.

    The state of a tenant is its last hash, so a trigger reads what arrived and nothing older; within a trigger entries
    are taken in the order of seq. A chain is sequential by nature: one task extends one tenant's, by one trigger's rows.
    """
    import hashlib

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def append(key, batches, state):
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(["seq", "payload"], kind="stable")
        hashes = [last]
        for seq, payload in zip(rows["seq"], rows["payload"]):
            hashes.append(hashlib.sha256("|".join([hashes[-1], str(seq), *([payload] if payload is not None else [])]).encode()).hexdigest())
        state.update((hashes[-1],))
        yield pd.DataFrame({"tenant_id": rows["tenant_id"], "seq": rows["seq"], "payload": rows["payload"], "prev_hash": hashes[:-1], "hash": hashes[1:]})

    out = "tenant_id string, seq long, payload string, prev_hash string, hash string"
    return entries.groupBy("tenant_id").applyInPandasWithState(append, out, "last string", "append", GroupStateTimeout.NoTimeout)


def retention_sweep(rows: DataFrame, days: int, now: Column, time: str = "created_at") -> DataFrame:
    """The rows young enough to stay; run with availableNow it sweeps what has arrived since the last run."""
    return apply_retention(rows, days, now, time)


def running_record(predictions: DataFrame, floor: int = 10) -> DataFrame:
    """The track record over all predictions so far (complete mode: one row a trigger)."""
    return track_record(predictions, floor)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet files and returns when it is done."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()


def settled(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream has made of all that is there now, as a table in the shared folder.

    Each trigger writes a folder of its own and overwrites it when it is repeated, so a restart repeats no row. In
    complete mode the last trigger holds the whole result, in append mode all of them together.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    try:
        out = spark.read.schema(f"{stream.schema.toDDL()}, epoch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):  # nothing has arrived yet
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        out = out.where(F.col("epoch") == out.agg(F.max("epoch")).first()[0])
    return out.drop("epoch")
