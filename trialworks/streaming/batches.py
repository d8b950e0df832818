"""Results of triggers, kept so that a repeated trigger repeats nothing and an unfinished one does not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _epochs(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def commit(path: str, epoch: int, tables: dict[str, DataFrame]) -> None:
    """Writes the tables of one trigger and then its mark. A trigger that is repeated overwrites its own folders; without a
    mark, whatever tables of it are there already are not read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
        spark = df.sparkSession
    spark.range(1).select(F.lit(epoch).cast("long").alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/epoch={epoch}")


def done(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the finished triggers, a row a trigger."""
    marks = _epochs(spark, path, "commits")
    found = [] if marks is None else sorted(r.done for r in marks.select("done").collect())
    return [e for e in found if before is None or e < before]


def committed(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a table from the finished triggers, with their ``epoch``; none where nothing has been written."""
    own = done(spark, path, before)
    if not own:
        return spark.createDataFrame([], f"{schema}, epoch long")
    return spark.read.schema(f"{schema}, epoch long").option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/epoch={e}" for e in own])
