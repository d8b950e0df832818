"""Exact duplicates after deleting white space, grouped by content hash and compared byte by byte. DataFrame only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.storage import written

#: The six characters that comparison ignores.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty. Plain byte replacement, no regular expression."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, parts: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting white space (null: empty). The row with the most code points in the
    original text, then the smallest id, stays. The grouping key is a 128-bit content hash with the bytes themselves
    beside it, so rows of one hash are told apart where their bytes differ. Copies within an input split are combined
    before the shuffle, so no group of copies meets in one task; only ids and hashes are joined back, a group's rows dealt
    to as many as ``parts`` places by their id. Texts of any length are compared whole.

    An empty table gives an empty result. A null id sorts after every other id. Rows that repeat id and text stay rows
    of their own, of which at most one is kept. Other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("doc_id", F.length("t").alias("chars"), squeezed(F.col("t")).alias("bytes"))
    base = base.withColumn("hash", F.md5("bytes"))
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id")))
    groups = base.groupBy("hash", "bytes").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("hash", F.sha2("bytes", 256).alias("text_sha256"), "best", "group_size")
    rows = base.select("doc_id", "chars", "hash", F.sha2("bytes", 256).alias("text_sha256"))
    keys = ["hash", "text_sha256"]
    rows = rows.groupBy("doc_id", "chars", *keys).agg(F.count("*").cast("int").alias("n"))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), "hashes")
    found = rows.select(*keys, "part").distinct().join(groups, keys)  # at most ``parts`` rows a group
    rows = rows.join(found, [*keys, "part"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    top = (F.col("chars") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", top.alias("kept"), "text_sha256", F.col("chars").alias("n_chars"))


def keep_best(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each group of :func:`exact_groups`, with all its columns: the one that stays, also where rows
    share an id or have none. Of rows alike in id and length the one whose text is least in byte order stays. No column name
    clashes; an empty table gives an empty result.
    """
    named = lambda sha, chars: F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("none")), sha, chars.cast("string")).alias("key")
    best = exact_groups(docs, text=text, doc_id=doc_id).where("kept").withColumnRenamed("doc_id", "id").select(named(F.col("text_sha256"), F.col("n_chars")))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.sha2(squeezed(F.col(text)), 256).alias("sha"), F.length(t).alias("chars"))
    found = rows.select("row", named(F.col("sha"), F.col("chars"))).join(best, "key", "left_semi")  # a key is one group's, so rows move once
    w = Window.partitionBy("key").orderBy(F.coalesce(F.col("row").getField(text), F.lit("")))
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("row.*")


def keep_rows(docs: DataFrame, ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, with all their columns; of rows repeating id and text, one.

    A null id in ``ids`` keeps rows with a null id. No column name clashes; an empty table gives an empty result.
    """
    ids = ids.select(F.col(doc_id).alias("keep")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    found = rows.join(ids, F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    w = Window.partitionBy("id", "hash").orderBy("hash")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("row.*")
