"""Where intermediate tables go: always a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local one of our own if all runs on one machine, as in
    tests; on a cluster, where executors would not share it, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trialworks-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy", by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors. ``by`` parts it by columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(table: DataFrame) -> None:
    """Deletes a table that :func:`written` made and that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` needs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
