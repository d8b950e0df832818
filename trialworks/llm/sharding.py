"""Shards cut from a Hilbert curve over document metadata, for pruning files by several columns at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialworks.operators.prefix import sum_before
from trialworks.storage import written


def hilbert_index(dims: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points whose coordinates are below 2 ** bits (axes to transpose, then interleave)."""
    x = [np.asarray(d, np.int64).copy() for d in dims]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess rotations, from the highest bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in x:
            out = out << 1 | ((d ^ t) >> b & 1)
    return out


def curve(columns: list[Column], bits: int) -> Column:
    """Hilbert index of integer columns, each below 2 ** bits."""

    @F.pandas_udf(T.LongType())
    def index(frame):
        import pandas as pd

        return pd.Series(hilbert_index([frame[c].to_numpy() for c in frame.columns], bits))

    return index(F.struct(*[c.cast("long").alias(f"x{i}") for i, c in enumerate(columns)]))


def cut_of(at: str, n: int, total: int) -> str:
    """Which of ``n`` runs of equal count row ``at`` of ``total`` lies in, in whole numbers."""
    return f"cast({at} as decimal(38,0)) * {n} div {max(total, 1)}"


def first_of(run: str, n: int, total: int) -> str:
    """The first row of a run."""
    return f"(cast({run} as decimal(38,0)) * {total} + {n - 1}) div {n}"


def equal_cuts(values: DataFrame, column: str, n: int) -> list:
    """(run, value) where a column's rows, in its order, go over from one of ``n`` runs of equal count to a later one.

    Counts per value are ordered in ranges and summed range by range, so no task holds all values. Nulls count nothing.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id().cast("long")), "values")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    first = sum_before(counts.groupBy("range").agg(F.sum("n").alias("n")), [], "range", "n", "first").select("range", "first")
    w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.join(first, "range").withColumn("at", F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    cuts = at.groupBy(F.expr(cut_of("at", n, total)).alias("run")).agg(F.min("v").alias("cut")).where("run > 0")  # n - 1 rows at most
    return sorted((r.run, r.cut) for r in cuts.collect())


def code(column: str, cuts: list) -> Column:
    """1 and the last run whose cut a value reaches; 0 for null."""
    reached = [F.when(F.col(column) >= F.lit(c), F.lit(run + 1)) for run, c in reversed(cuts)]
    return F.when(F.col(column).isNotNull(), F.coalesce(*reached, F.lit(1))).otherwise(0)


def shard(
    docs: DataFrame, shards: int = 8, bits: int = 4, rows_per_bucket: int = 20_000, text: str = "text", doc_id: str = "doc_id",
    lang: str = "lang", source: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source, cell for every row, by the law ``rows``.

    Language, source (both in byte order) and size are quantised to 2 ** ``bits`` - 1 runs of about equal count each, a
    value being in one run only, and cells are ordered by their Hilbert index. Rows with equal texts are a group, which
    lies in the least cell of its rows, whatever their languages and sources. Cells, and in them groups by the text's
    checksum, and in them rows by a hash of the id, form one line, cut into runs whose row counts differ by one at most: a
    group is split only where a cut falls inside it. ``slot`` is the place in the run.

    Ranks are found from counts per (cell, range of checksums) and in these per (text, range of hashed ids), so neither a
    hot cell nor a text with very many copies is ordered in one task. Neither ``rows_per_bucket`` nor the number of
    tasks changes the result.

    Null columns form values of their own (a null text has size 1 and the checksum of the empty text); rows may repeat;
    long texts count whole; an empty table gives an empty result. Other columns are ignored.
    """
    words = lambda c: F.col(c).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), words(lang).alias("lang"), words(source).alias("source"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("draw"),
    )
    rows = written(rows, "metadata")
    total = rows.count()
    runs = (1 << bits) - 1
    codes = [code(c, equal_cuts(rows, c, runs)) for c in ("lang", "source", "size")]
    rows = rows.withColumn("cell", curve(codes, bits))
    # One range of hashed ids for about ``rows_per_bucket`` rows, were they all copies of one text.
    near = max(0, (total // rows_per_bucket).bit_length())
    group, part = ["text_crc32", "text_hash", "size"], F.shiftright("draw", 64 - near) if near else F.lit(0).cast("long")
    rows = rows.withColumn("part", part)
    cells = rows.groupBy(*group, "part").agg(F.min("cell").alias("low"))
    least = cells.groupBy(*group).agg(F.min("low").alias("group_cell"))
    home = cells.select(*group, "part").join(least, group)  # a row per text and range of ids
    rows = rows.drop("cell").join(home, [*group, "part"]).withColumnRenamed("group_cell", "cell")
    parts = max(1, -(-total // rows_per_bucket))
    rows = written(rows.withColumn("place", F.col("cell") * parts + F.floor(F.col("text_crc32") * parts / F.lit(1 << 32)).cast("long")), "cells")
    counts = rows.groupBy("place", *group, "part").agg(F.count("*").alias("n"))
    firsts = sum_before(counts.groupBy("place").agg(F.sum("n").alias("n")), [], "place", "n", "first").select("place", "first")
    w = Window.partitionBy("place").orderBy(*group, "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.join(firsts, "place").withColumn("base", F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0))).select("place", *group, "part", "base")
    w = Window.partitionBy("place", *group, "part").orderBy("draw", "doc_id", "lang", "source")
    rows = rows.withColumn("at", F.row_number().over(w) - 1).join(bases, ["place", *group, "part"]).withColumn("at", F.col("base") + F.col("at"))
    rows = rows.withColumn("shard", F.expr(cut_of("at", shards, total)).cast("int"))
    start = F.expr(first_of("shard", shards, total))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "cell")
