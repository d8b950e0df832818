"""Leakage groups, deterministic grouped splits, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialworks.functions import text as X
from trialworks.operators.components import connected_components
from trialworks.operators.prefix import sum_before
from trialworks.operators.ranks import counted_ranges, values_at
from trialworks.storage import unused, written


def leakage_groups(arms: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds group_id: rows connected through a shared experiment or a shared normalised copy. One star per key, no pairs.

    An experiment is its least row from the start, and only copies (and ids, where they repeat) that join several of these
    become edges, so the components are sought among few of the rows. The result is written once.
    """
    one, copy = unused(arms, "one"), unused(arms, "copy")
    test = unused(arms, "test")
    keyed = arms.withColumn(test, F.struct(F.col("test_id").cast("string").alias("v")))
    least = keyed.groupBy(test).agg(F.min(row_id).alias(one))
    rows = keyed.join(least, test).drop(test).withColumn(copy, F.struct(X.norm_headline(F.col("copy_text")).alias("v")))
    rows = written(rows, "rows")
    known = rows.where(F.col(row_id).isNotNull())
    edges = None
    for key in (copy, row_id):
        ends = known.select(F.col(key).alias("key"), F.col(one).alias("dst"))
        several = ends.groupBy("key").agg(F.min("dst").alias("src"), F.max("dst").alias("last")).where("src <> last").select("key", "src")
        found = ends.join(several, "key").where("src <> dst").select("src", "dst").distinct()
        edges = found if edges is None else edges.union(found)
    found = connected_components(edges).select(F.col("id").alias(one), F.col("component").alias("group_id"))
    rows = rows.drop(copy).join(found, one, "left").withColumn("group_id", F.when(F.col(row_id).isNotNull(), F.coalesce("group_id", one)))
    return written(rows.select(*[F.col(f"`{c}`") for c in arms.columns], "group_id"), "leakage-groups")


def component_guard(groups: DataFrame, limit: float = 0.20, strict: bool = True) -> DataFrame:
    """One row: groups, rows, the largest and its share. Above the limit the query fails, or says so where not strict."""
    sizes = groups.groupBy("group_id").count()
    out = sizes.agg(F.count("*").alias("groups"), F.sum("count").alias("n_rows"), F.max("count").alias("largest")).withColumn("share", F.col("largest") / F.col("n_rows"))
    ok = F.col("share") <= limit
    if strict:
        return out.withColumn("passed", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("one group holds too large a share of the rows")).cast("boolean")))
    return out.withColumn("passed", ok)


def group_order(group: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", group.cast("string"), F.lit(str(seed))).cast("binary"))


def hash_places(groups: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Adds at: the place from 0 of each row's group_id in hash order, within ``by``. Rows have distinct (by, group_id).

    Buckets by the hash's first four digits are counted first, so no task ranks all groups of a stratum.
    """
    g = groups.withColumn("h", group_order(F.col("group_id"), seed))
    g = g.withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("long"))
    first = sum_before(g.groupBy(*by, "bucket").agg(F.count("*").alias("c")), by, "bucket", "c", "first").select(*by, "bucket", "first")
    at = F.col("first") + F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("h", "group_id")) - 1
    return g.join(first, [*by, "bucket"]).withColumn("at", at).drop("h", "bucket", "first")


def grouped_split(groups: DataFrame, shares: tuple[float, float] = (0.70, 0.15), seed: int = 7, exact: bool = True) -> DataFrame:
    """Adds split to every row; whole groups only.

    Groups are ordered by a hash. The exact mode cuts the order at round(share * groups) (the rank is found on one row a
    group); the other mode compares the hash with the shares and needs neither a rank nor a shuffle.
    """
    if not exact:
        u = F.conv(F.substring(group_order(F.col("group_id"), seed), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
        return groups.withColumn("split", F.when(u < shares[0], "train").when(u < sum(shares), "val").otherwise("test"))
    g = written(groups.select("group_id").distinct(), "groups")
    n = g.count()
    a, b = round(n * shares[0]), round(n * shares[0]) + round(n * shares[1])
    g = hash_places(g, [], seed)
    g = g.select("group_id", F.when(F.col("at") < a, "train").when(F.col("at") < b, "val").otherwise("test").alias("split"))
    return groups.join(g, "group_id")


def split_crossing(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def verify_split(rows: DataFrame) -> DataFrame:
    """(rule, violations): every row has a split, no group and no normalised copy crosses."""
    rows = rows.withColumn("__copy", X.norm_headline(F.col("copy_text")))
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    return count("no split", rows.where("split is null")).union(count("group crosses", split_crossing(rows, "group_id"))).union(count("copy crosses", split_crossing(rows, "__copy")))


def split_profile(rows: DataFrame, target: str = "target") -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"), F.stddev_pop(target).alias("target_sd"))


def group_sample(groups: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """Whole groups in hash order while the rows before them stay below the budget."""
    g = groups.groupBy("group_id").agg(F.count("*").alias("n")).withColumn("h", group_order(F.col("group_id"), seed))
    g = g.withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("long"))
    first = sum_before(g.groupBy("bucket").agg(F.sum("n").alias("c")), [], "bucket", "c", "first").select("bucket", "first")
    w = Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    g = g.join(first, "bucket").withColumn("before", F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    return groups.join(g.where(F.col("before") < budget).select("group_id"), "group_id", "left_semi")


def temporal_split(rows: DataFrame, share: float = 0.60, time: str = "created_at", row_id: str = "row_id") -> DataFrame:
    """Adds early: whether a row is among the first ``share`` by time, ties by id. A row without a time is left out.

    The cut is found from counts per instant in ranges of time, and inside the instant that it falls into from counts per id
    in ranges of the id; no rows are ranked. Ids are distinct.
    """
    d = rows.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp"))).where("__us is not null")
    counts, n = counted_ranges(d, "__us")
    cut = int(n * share)
    last = counts.where((F.col("at") < cut) & (F.col("at") + F.col("n") >= cut)).first()  # the instant of the last early row
    if last is None:
        return d.withColumn("early", F.lit(False)).drop("__us")
    early = F.col("__us") <= last.v
    if last["at"] + last.n > cut:
        rank = cut - last["at"] - 1
        edge = values_at(d.where(F.col("__us") == last.v), row_id, [rank])[rank]
        early = (F.col("__us") < last.v) | ((F.col("__us") == last.v) & (F.col(row_id) <= F.lit(edge)))
    return d.withColumn("early", early).drop("__us")


def fingerprint(rows: DataFrame, text: str = "copy_text") -> DataFrame:
    """One row: a content hash of a table, whatever its row order. Rows are counted by hash, hashed by bucket, then all."""
    h = F.sha2(X.norm_ws_lower(F.coalesce(F.col(text), F.lit(""))), 256)
    counts = rows.select(h.alias("h")).groupBy("h").agg(F.concat_ws(" ", "h", F.count("*").cast("string")).alias("line"))
    lines = counts.select(F.substring("h", 1, 6).alias("b"), "h", F.col("line").alias("s"))
    for digits in (6, 3):  # a bucket of six digits holds a row in 16 million, one of three digits up to 4096 of those
        level = F.transform(F.array_sort(F.collect_list(F.struct("h", "s"))), lambda x: x["s"])
        lines = lines.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sha2(F.array_join(level, "\n"), 256).alias("s")).withColumn("h", F.col("b"))
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "s"))), lambda x: x["s"]), "\n"), 256).alias("fingerprint"))


def carve_dev(split: DataFrame, share: float = 0.15, seed: int = 8) -> DataFrame:
    """The training rows with part: whole groups in hash order, the last ``share`` of them as dev, the rest as fit."""
    rows = grouped_split(split.where("split = 'train'").drop("split"), (1 - share, share), seed)
    return rows.withColumn("part", F.when(F.col("split") == "train", "fit").otherwise("dev")).drop("split")


def stratified_split(groups: DataFrame, stratum: str, shares: tuple[float, float] = (0.70, 0.15), seed: int = 7) -> DataFrame:
    """Adds split: groups are dealt by hash order within the stratum that most of their rows have (ties: the smaller)."""
    n = groups.groupBy("group_id", stratum).agg(F.count("*").alias("n"))
    main = n.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(stratum).alias("stratum")))["stratum"].alias("stratum"))
    main = main.withColumn("key", F.struct(F.col("stratum").isNull().alias("none"), F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("s"))).select("group_id", "key")
    sizes = main.groupBy("key").agg(F.count("*").alias("all"))
    g = hash_places(main, ["key"], seed).join(sizes, "key")
    a, b = F.round(F.col("all") * shares[0]), F.round(F.col("all") * shares[0]) + F.round(F.col("all") * shares[1])
    return groups.join(g.select("group_id", F.when(F.col("at") < a, "train").when(F.col("at") < b, "val").otherwise("test").alias("split")), "group_id")


def coverage_check(corpus: DataFrame, cover: DataFrame, key: str) -> DataFrame:
    """(rule, violations): keys that the cover lacks, has though the corpus does not, or has more than once."""
    c, s = corpus.select(key).distinct(), cover.groupBy(key).agg(F.count("*").alias("n"))
    both = c.withColumn("in_corpus", F.lit(True)).join(s, key, "full_outer")
    sums = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("in_corpus").isNull()).alias("foreign"), F.count_if(F.col("n") > 1).alias("repeated"))
    return sums.select(F.stack(F.lit(3), F.lit("missing"), F.col("missing"), F.lit("foreign"), F.col("foreign"), F.lit("repeated"), F.col("repeated")).alias("rule", "violations"))


def lock(test: DataFrame, path: str, text: str = "copy_text") -> str:
    """The fingerprint of the test rows, written at the first call and compared at every later one."""
    spark, now = test.sparkSession, fingerprint(test, text).first().fingerprint
    try:
        stored = spark.read.parquet(f"{path}/lock").first().fingerprint
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([(now,)], "fingerprint string").write.parquet(f"{path}/lock")
        return now
    if stored != now:
        raise ValueError("the test rows differ from those that were locked")
    return now


def unlock_test(test: DataFrame, path: str, reason: str, evaluation: str, text: str = "copy_text") -> DataFrame:
    """The test rows, after the lock has been checked and the read logged; a read without a real reason is refused."""
    if len(reason.strip()) < 20:
        raise ValueError("say in at least 20 characters why the test rows are read")
    now, spark = lock(test, path, text), test.sparkSession
    entry = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(reason.strip()).alias("reason"), F.lit(evaluation).alias("evaluation"), F.lit(now).alias("fingerprint"), F.lit(test.count()).alias("n"))
    entry.write.mode("append").parquet(f"{path}/reads")
    return test


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The reads of the test rows so far, oldest first; empty before the first."""
    schema = "at timestamp, reason string, evaluation string, fingerprint string, n long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/reads").orderBy("at", "evaluation")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
