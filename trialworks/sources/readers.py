"""Declared-schema readers and writers for experiment data."""

from __future__ import annotations

import re
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARM_COLUMNS = ["test_id", "headline", "excerpt", "lede", "eyecatcher_id", "impressions", "clicks", "test_week", "created_at", "winner"]
# What a header, in lower case and without all but letters and digits, names; the first rule that fits it wins.
HEADER_RULES = [
    (r"(link)?clicks?", "clicks"),
    (r"(all|unique|outbound|website)?(link)?clicks?", "clicks"),
    (r"(impr|impressions?|views?|reach)", "impressions"),
    (r"(copy|text|headline\d*|title|body|creative|addcopy|adcopy|description\d*)", "copy"),
    (r"(segment|audience|agerange|age|gender|sex)", "segment"),
    (r"(campaign|campaignid|campaignname|adsetname|adname|adid)", "campaignId"),
]
CAMPAIGN_COLUMNS = ["copy", "impressions", "clicks", "segment", "campaignId"]


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def read_experiments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Quoted multi-line CSV of several releases as strings, with the release; columns are found by name.

    A release whose file is missing is warned of and skipped; without any there is an empty table.
    """
    columns = [*ARM_COLUMNS, "release"]
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    for release, path in paths.items():
        try:
            df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
        except Exception as e:
            if not _missing(e):
                raise
            warnings.warn(f"release {release} is missing: {path}", stacklevel=2)
            continue
        df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ARM_COLUMNS], F.lit(release).alias("release"))
        out = out.unionByName(df)
    return out.withColumnsRenamed({"headline": "copy_text", "eyecatcher_id": "image_id"})


def read_nested(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows by the declared schema, corrupt lines with their file, one row of counts) of JSON lines; blank lines are none.

    A line that is no JSON, or whose values do not fit the schema, is held back whole. The counts are of all lines.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")).where(F.length(F.trim("line")) > 0)
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, `_corrupt` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    counts = parsed.agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("corrupt"))
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("file", "line"), counts


def read_jsonl(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema; blank lines are none."""
    return spark.read.schema(schema).json(glob)


def read_parquet_text(spark: SparkSession, glob: str, columns: list[str], text: str = "text") -> DataFrame:
    """Only the named columns are read; rows without text are dropped."""
    return spark.read.parquet(glob).select(*columns).where(F.length(F.trim(text)) > 0)


def pick_text(candidates: list[str], others: list[str]) -> Column:
    """The first candidate that is not blank, else the longest of the other string columns."""
    blank_free = [F.nullif(F.trim(c), F.lit("")) for c in candidates]
    longest = F.array_max(F.array(*[F.struct(F.length(c).alias("n"), F.col(c).alias("v")) for c in others]))["v"] if others else F.lit(None)
    return F.coalesce(*blank_free, longest)


def collect_meta(columns: list[str]) -> Column:
    """The remaining scalar columns as a map, without nulls."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns])), lambda k, v: v.isNotNull())


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """Our column names by the export's header that names each: of several headers the first."""
    found: dict[str, str] = {}
    for i, h in enumerate(headers):
        plain = h[: -len(str(i))] if h.endswith(str(i)) else h  # repeated headers come with their place behind them
        h_key = h if sum(x.lower().startswith(plain.lower()) and x.lower()[len(plain) :].isdigit() for x in headers) < 2 else plain
        key = re.sub("[^a-z0-9]", "", h_key.lower())
        name = next((n for rule, n in HEADER_RULES if re.fullmatch(rule, key)), None)
        if name:
            found.setdefault(name, h)
    return found


def read_campaign_export(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """(rows, missing required columns): a vendor's CSV under our column names as trimmed text; rows stay distributed.

    Only the header is read here. Without a required column there are no rows, and the columns that are missing are told.
    """
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    found = resolve_headers(df.columns)
    missing = [c for c in ("copy", "impressions", "clicks") if c not in found]
    if missing:
        return None, missing
    return df.select(*[(F.col(f"`{found[c]}`") if c in found else F.lit(None).cast("string")).alias(c) for c in CAMPAIGN_COLUMNS]), []


def read_responses(spark: SparkSession, path: str, seed: int, participant: str = r"([^/]+)\.json$") -> DataFrame:
    """One JSON file per participant, answers exploded; a file with another seed is an error.

    ``participant`` finds the participant in the file's path: by default the file's name.
    """
    schema = "seed long, n int, profile struct<years: int, paid: boolean>, answers array<struct<id: string, choice: int, ms: long>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("participant", F.regexp_extract(F.col("_metadata.file_path"), participant, 1))
    sound = F.when(F.col("seed") == seed, F.lit(True)).otherwise(F.raise_error(F.lit("a response belongs to another quiz")).cast("boolean"))
    return df.where(sound).select("participant", "profile.years", "profile.paid", F.explode("answers").alias("a")).select("participant", "years", "paid", F.col("a.id").alias("item"), "a.choice", "a.ms")


def write_split_dataset(df: DataFrame, path: str) -> None:
    """Rows by split, and a small manifest with their counts."""
    df.write.partitionBy("split").parquet(f"{path}/rows")
    df.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups")).coalesce(1).write.parquet(f"{path}/manifest")


def write_labelled_arms(df: DataFrame, path: str) -> DataFrame:
    """Writes labelled arms by release and returns them as read back; a table that is there already is an error."""
    df.write.partitionBy("release").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def incremental_ingest(source: DataFrame, path: str, key: str) -> int:
    """Appends the rows of ``source`` whose key ``path`` lacks, and returns how many there were.

    A load is one folder, and its name is noted under ``path``/loads only once it is whole. So a load that was cut off
    does not pass for a complete one: its keys are missing still and are loaded again.
    """
    spark, new = source.sparkSession, source.dropDuplicates([key])
    there = ingested(spark, path)
    if there is not None:
        new = new.join(there.select(key), key, "left_anti").select(*source.columns)
    name = f"load-{uuid.uuid4().hex}"
    new.write.parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(name).alias("load")).write.mode("append").parquet(f"{path}/loads")
    return spark.read.schema(source.schema).parquet(f"{path}/{name}").count()


def ingested(spark: SparkSession, path: str) -> DataFrame | None:
    """All whole loads of :func:`incremental_ingest`, or None where there is none."""
    try:
        loads = [r.load for r in spark.read.parquet(f"{path}/loads").collect()]  # a row per load
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(*[f"{path}/{name}" for name in loads])
