"""Tenants: recalibrated weights for all at once, and tables that only their owner reads, with an audit of every access."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.operators.privacy import TENANT, tenant_stamp
from trialworks.storage import written


def recalibrate(
    pairs: DataFrame, features: list[str], start: list[float], tenant: str = "tenant_id", penalty: float = 1.0, steps: int = 6, floor: int = 200, small: int = 10_000,
) -> DataFrame:
    """(tenant, n, shrinkage, own, weights): a pairwise linear ranker for every tenant, near the global one.

    ``pairs`` has the winner's features less the loser's. A tenant's own weights minimise the sum of
    softplus(-w . x) + penalty / 2 |w - start|^2 by ``steps`` Newton steps from ``start``. Each step is one aggregate over
    all tenants' rows: gradient and curvature sums are combined before the shuffle, so a tenant with a third of all rows
    meets in one row per task; only the small system of a tenant is solved in Python. Then the weights are blended:
    shrinkage 1 - n / ``floor`` of the global ones below ``floor`` rows, none from there on.

    Weights travel to the rows by broadcast while there are at most ``small`` tenants, else by a shuffle join. A null tenant
    is a tenant; nulls among the features count as 0.
    """
    k = len(features)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = written(pairs.select(F.coalesce(F.col(tenant).cast("string"), F.lit("")).alias("tenant"), F.col(tenant).isNull().alias("none"), x.alias("x")), "pairs")
    key = ["tenant", "none"]
    weights = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("own", F.array(*[F.lit(float(v)) for v in start]))
    weights = written(weights, "weights")
    hint = F.broadcast if weights.count() <= small else (lambda df: df)
    at = lambda i: F.col("x")[i]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    schema = "tenant string, none boolean, n long, own array<double>"

    def newton(batches):
        import pandas as pd

        for b in batches:
            out = []
            for own, g, h in zip(b["own"], b["g"], b["h"]):
                curve = penalty * np.eye(k)
                for (i, j), v in zip(upper, h):
                    curve[i, j] += v
                    if i != j:
                        curve[j, i] += v
                own = np.asarray(own, float)
                out.append((own - np.linalg.solve(curve, np.asarray(g, float) + penalty * (own - np.asarray(start, float)))).tolist())
            yield pd.DataFrame({"tenant": b["tenant"], "none": b["none"], "n": b["n"], "own": out})

    for _ in range(steps):
        score = sum((F.col("own")[i] * at(i) for i in range(k)), F.lit(0.0))
        p = S.sigmoid(-score)
        d = rows.join(hint(weights), key).select(*key, "n", "own", "x", p.alias("p"))
        sums = d.groupBy(*key, "n", "own").agg(F.array(*[F.sum(-F.col("p") * at(i)) for i in range(k)]).alias("g"), F.array(*[F.sum(F.col("p") * (1 - F.col("p")) * at(i) * at(j)) for i, j in upper]).alias("h"))
        weights = written(sums.mapInPandas(newton, schema), "weights")
    keep = F.greatest(F.lit(0.0), 1 - F.col("n") / F.lit(float(floor)))
    mix = F.array(*[F.col("shrinkage") * float(start[i]) + (1 - F.col("shrinkage")) * F.col("own")[i] for i in range(k)])
    out = weights.withColumn("shrinkage", keep).withColumn("weights", mix)
    return out.select(F.when(~F.col("none"), F.col("tenant")).alias(tenant), "n", "shrinkage", "own", "weights")


def score_by(weights: Column, features: list[str]) -> Column:
    return sum((weights[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)), F.lit(0.0))


LOG = "action string, resource string, tenant_id string, actor_id string, record_id string, n long"


class TenantTable:
    """A table of many tenants in one folder a tenant, read and written as one of them; each access leaves an audit row.

    Reads prune to the tenant's folder. An id that another tenant owns looks as if it were nowhere, and is audited as
    ``cross_tenant_denied``. Rows written bear the tenant's id, whatever they claim. Each write and each audit is a folder of
    its own, so none overwrites another's.
    """

    def __init__(self, spark: SparkSession, path: str, tenant_id: str, actor_id: str, resource: str, schema: str, key: str = "id"):
        if not re.match(TENANT, tenant_id):
            raise ValueError("not a tenant id")
        self.spark, self.path, self.tenant_id, self.actor_id, self.resource, self.key = spark, path.rstrip("/"), tenant_id, actor_id, resource, key
        self.schema = f"{schema}, tenant_id string, load string"

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def _audit(self, rows: DataFrame) -> None:
        me = {"resource": self.resource, "tenant_id": self.tenant_id, "actor_id": self.actor_id}
        rows = rows.withColumns({k: F.lit(v) for k, v in me.items()})
        rows.select("action", "resource", "tenant_id", "actor_id", F.col("record_id").cast("string").alias("record_id"), F.col("n").cast("long").alias("n")).write.parquet(f"{self.path}/audit/entry-{uuid.uuid4().hex}")

    def _one(self, action: str, n: int) -> None:
        self._audit(self.spark.range(1).select(F.lit(action).alias("action"), F.lit(None).alias("record_id"), F.lit(n).alias("n")).coalesce(1))

    def insert(self, rows: DataFrame) -> None:
        """Appends rows; ``insert`` is audited with each id."""
        load = uuid.uuid4().hex
        tenant_stamp(rows, self.tenant_id).withColumn("load", F.lit(load)).write.mode("append").partitionBy("tenant_id", "load").parquet(f"{self.path}/rows")
        mine = self._all().where((F.col("tenant_id") == self.tenant_id) & (F.col("load") == load))
        self._audit(mine.select(F.lit("insert").alias("action"), F.col(self.key).alias("record_id"), F.lit(1).alias("n")))

    def list(self) -> DataFrame:
        """The tenant's rows; the read is audited with their number."""
        mine = self._all().where(F.col("tenant_id") == self.tenant_id)
        self._one("read", mine.count())
        return mine.drop("load")

    def get(self, ids: DataFrame) -> DataFrame:
        """Of the ids asked for (a column named like the key) the tenant's own rows."""
        ids = ids.select(self.key).distinct()
        rows = self._all()
        mine = rows.where(F.col("tenant_id") == self.tenant_id).join(ids, self.key, "left_semi")
        others = rows.where(F.col("tenant_id") != self.tenant_id).select(self.key).join(ids, self.key, "left_semi").distinct()
        denied = others.join(rows.where(F.col("tenant_id") == self.tenant_id).select(self.key), self.key, "left_anti")
        self._audit(denied.select(F.lit("cross_tenant_denied").alias("action"), F.col(self.key).alias("record_id"), F.lit(1).alias("n")))
        return mine.drop("load")


def insert_all(rows: DataFrame, path: str, actor_id: str, resource: str, key: str = "id") -> None:
    """A load of many tenants' rows (with ``tenant_id``) by one who may: one write, one audit row of ``insert`` for each row.

    A tenant id that breaks the rule is an error, and nothing is written.
    """
    bad = rows.where(F.col("tenant_id").isNull() | ~F.col("tenant_id").rlike(TENANT)).limit(1).count()
    if bad:
        raise ValueError("not a tenant id")
    spark, path, load = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    rows.withColumn("load", F.lit(load)).repartition("tenant_id", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("append").partitionBy("tenant_id", "load").parquet(f"{path}/rows")
    there = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("load") == load)
    log = there.select(F.lit("insert").alias("action"), F.lit(resource).alias("resource"), F.col("tenant_id").cast("string").alias("tenant_id"), F.lit(actor_id).alias("actor_id"), F.col(key).cast("string").alias("record_id"), F.lit(1).cast("long").alias("n"))
    log.write.parquet(f"{path}/audit/entry-{uuid.uuid4().hex}")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All audit rows of :class:`TenantTable` under ``path``."""
    try:
        return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/audit")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)
