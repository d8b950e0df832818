"""Interleaving sources to target weights by Pfair scheduling. DataFrame only."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.operators.prefix import sum_before
from trialworks.storage import unused, written

#: Target weights are scaled by a power of two, which keeps their ratios, and rounded to whole numbers of about so many
#: bits: rounding moves a source by one block in 2 ** 40 slots at most.
BITS = 40
#: Blocks that one row is exploded into at a time.
RUN = 4096


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def pfair_blocks(sources: DataFrame) -> DataFrame:
    """(i, k, release, deadline) of every block. ``sources`` (i, w, n), a row per source: whole weight and blocks.

    The ideal serves all sources that have blocks left at once, each by its weight among these. It has served k blocks of
    source i at v = k / w(i), when all sources together have had t(v) = sum over j of min(v * w(j), n(j)) slots; block k is
    released at floor(t(k / w)) and due at ceil(t((k + 1) / w)). While no source is used up, t(v) = v * (sum of weights),
    and these are the releases floor(k / share) and deadlines ceil((k + 1) / share) of Pfair scheduling. All is computed
    in whole numbers, per block and from its number alone.
    """
    all_ = sources.agg(F.collect_list(F.struct("w", "n")).alias("all"))  # one row, an entry per source
    runs = sources.select("i", "w", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    blocks = runs.repartition("i", "run").withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    blocks = blocks.crossJoin(F.broadcast(all_))

    def served(k: Column) -> Column:  # t(k / w) times w
        part = lambda a, x: _whole(a + F.least(_whole(k) * x["w"], _whole(x["n"]) * F.col("w")))
        return F.aggregate("all", _whole(F.lit(0)), part)

    blocks = blocks.select("i", "k", "w", served(F.col("k")).alias("from"), served(F.col("k") + 1).alias("to"))
    return blocks.select("i", "k", F.expr("`from` div w").alias("release"), F.expr("(`to` + w - 1) div w").alias("deadline"))


def _run_segment(jobs: DataFrame, length: int) -> DataFrame:
    """Earliest deadline first over each segment's slots. ``jobs`` (segment, last, of, done): the slots end before ``last``;
    of each source, its blocks in order; the sources whose first block, begun before the segment, is done.

    Adds run, the block of each slot, and end, the sources whose block that reaches beyond the segment is done.
    """
    def step(state: Column, t: Column) -> Column:
        def head(x: Column, j: Column) -> Column:  # the next block of a source, if it is released; its deadline and source lead
            b = F.get(x["blocks"], F.element_at(state["at"], j + 1))
            return F.when(b["release"] <= t, F.struct(b["deadline"].alias("deadline"), x["i"].alias("i"), b["k"].alias("k"), b["release"].alias("release"), j.alias("j")))

        def serve(first: Column) -> Column:
            at = F.transform(state["at"], lambda n, j: n + F.when(j == first["j"], 1).otherwise(0))
            return F.struct(at.alias("at"), F.concat(state["run"], F.array(F.struct(t.alias("slot"), *[first[c].alias(c) for c in ("i", "k", "release", "deadline")]))).alias("run"))

        # A transform of one element, so that the choice is made once a slot and not wherever it is used.
        return F.transform(F.array(F.array_min(F.transform("of", head))), serve)[0]

    at = F.transform("of", lambda x: F.when(F.array_contains(F.col("done"), x["i"]), 1).otherwise(0))
    none = F.array().cast("array<struct<slot: bigint, i: int, k: bigint, release: bigint, deadline: bigint>>")
    ran = jobs.withColumn("s", F.aggregate(F.sequence(F.col("segment") * length, F.col("last") - 1), F.struct(at.alias("at"), none.alias("run")), step))
    over = F.filter("of", lambda x, j: (F.element_at(F.col("s.at"), j + 1) == F.size(x["blocks"])) & (F.element_at(x["blocks"], -1)["deadline"] > F.col("last")))
    return ran.select("segment", "done", F.col("s.run").alias("run"), F.transform(over, lambda x: x["i"]).alias("end"))


def pfair_slots(blocks: DataFrame, length: int) -> DataFrame:
    """(i, k, release, deadline, slot) of the blocks of :func:`pfair_blocks`, by earliest deadline first, ties to the smaller i.

    Segments of ``length`` slots run side by side. At a segment's start each source has at most one block that is begun
    and not due; which of these are done is first assumed (those due first) and then taken from the end of the segment
    before, until every segment has run from the true end of the one before it. Two rounds are usual: what was assumed
    is mostly forgotten within a segment. The result is that of one run over all slots.
    """
    total = blocks.count()
    spans = blocks.withColumn("segment", F.explode(F.sequence(F.floor(F.col("release") / length), F.floor((F.col("deadline") - 1) / length))))
    of = spans.groupBy("segment", "i").agg(F.array_sort(F.collect_list(F.struct("k", "release", "deadline"))).alias("blocks"))
    of = of.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("i", "blocks"))).alias("of"))  # length + 2 a source at most
    due = blocks.groupBy(F.floor((F.col("deadline") - 1) / length).alias("segment")).agg(F.count("*").alias("n"))
    due = spans.select("segment").distinct().join(due, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))
    due = sum_before(due, [], "segment", "n", "due").select("segment", "due")
    begun = F.filter(F.transform("of", lambda x: F.struct(x["blocks"][0]["deadline"].alias("deadline"), x["i"].alias("i"), x["blocks"][0]["release"].alias("release"))), lambda x: x["release"] < F.col("segment") * length)
    jobs = of.join(due, "segment").withColumn("m", (F.col("segment") * length - F.col("due")).cast("int"))
    first = F.array_sort(F.transform(F.slice(F.array_sort(begun), F.lit(1), F.greatest("m", F.lit(0))), lambda x: x["i"]))
    jobs = written(jobs.select("segment", "of", "m", F.least(F.lit(total), (F.col("segment") + 1) * length).cast("long").alias("last"), first.alias("done")), "segments")
    ran = written(_run_segment(jobs, length), "slots")
    while True:
        ends = ran.select((F.col("segment") + 1).alias("segment"), F.array_sort("end").alias("end"))
        now = ends.join(jobs.select("segment", "m"), "segment").where(F.size("end") == F.col("m")).join(ran.select("segment", "done"), "segment")
        changed = written(now.where(F.col("end") != F.col("done")).select("segment", F.col("end").alias("done")), "changed")
        if changed.isEmpty():
            return ran.select(F.explode("run").alias("b")).select("b.i", "b.k", "b.release", "b.deadline", "b.slot")
        again = _run_segment(jobs.drop("done").join(changed, "segment"), length)
        ran = written(ran.join(changed.select("segment"), "segment", "left_anti").unionByName(again), "slots")


def pfair_plan(sources: DataFrame, length: int) -> DataFrame:
    """(key, block, release, deadline, slot) of every block. ``sources`` (key, weight, n) is a row per source.

    Sources without a positive weight are due nothing: they follow all others, in equal shares.
    """
    positive = F.col("weight") > 0
    s = sources.withColumn("late", ~F.coalesce(positive, F.lit(False))).withColumn("i", F.row_number().over(Window.orderBy("key")).cast("int"))  # a row per source
    s = written(s, "sources")
    sizes, plans, before = {r.late: r for r in s.groupBy("late").agg(F.sum("n").alias("n"), F.max("weight").alias("top")).collect()}, [], 0
    for late in sorted(sizes):
        w = F.lit(1) if late else F.greatest(F.lit(1), F.floor(F.col("weight") * 2.0 ** (BITS - round(math.log2(sizes[late].top))) + 0.5))
        blocks = written(pfair_blocks(s.where(F.col("late") == late).select("i", _whole(w).alias("w"), "n")), "blocks")
        at = pfair_slots(blocks, length)
        plans.append(at.select("i", F.col("k").alias("block"), *[(F.col(c) + before).alias(c) for c in ("release", "deadline", "slot")]))
        before += sizes[late].n
    out = plans[0] if plans else s.select("i", *[F.lit(0).cast("long").alias(c) for c in ("block", "release", "deadline", "slot")])
    for p in plans[1:]:
        out = out.unionByName(p)
    return out.join(F.broadcast(s.select("i", "key")), "i").drop("i")  # a row per source


def mix(
    docs: DataFrame, block_size: int = 16_384, power: float = 0.5, weights: DataFrame | None = None, segment: int = 2048, buckets: int = 4096,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """Places every document on a line of slots: doc_id, source, size, block, release, deadline, slot, slot_offset,
    and text_hash, which tells apart rows that repeat an id.

    A source's documents, in an order that a hash of the id fixes, form a line of bytes (each document counts its
    UTF-8 bytes and one more); ``block_size`` bytes are a block, and a document belongs to the block where it starts.
    Blocks are scheduled to the target weights, ``weights`` (source, weight) or else each source's bytes to the power
    ``power``: each block has a Pfair release slot and deadline (:func:`pfair_blocks`), and earliest deadline first runs one
    block a slot (:func:`pfair_slots`). After any slot every source has had within one block of its due, which is its
    weight's share of all slots until a source is used up; from then on the others share its part by their weights.
    Sources without a positive weight follow all others. Every row stays. ``slot_offset`` is the document's place within
    its block, so (slot, slot_offset) is a total order but for documents that repeat an id.

    Sizes are summed per (source, one of ``buckets`` ranges of hashed ids) first, and a task orders one such bucket, so
    ``buckets`` should grow with the largest source. It fixes the order of documents, as do ``block_size`` and the weights.
    Null texts count as empty, a null source is a source of its own, a null id sorts first; repeated rows stay; texts
    longer than a block start in one block and leave the next ones of their source empty; an empty table gives an empty
    result. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn(
        "bucket", F.coalesce(F.pmod(F.pmod(F.col("doc_id"), F.lit(1_000_003)) * 7919, F.lit(buckets)), F.lit(0))
    )
    sums = written(rows.groupBy("key", "bucket").agg(F.sum("size").alias("size")), "sums")
    base = sum_before(sums, ["key"], "bucket", "size", "base").select("key", "bucket", "base")
    w = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(base, ["key", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("inside"))
    rows = rows.withColumn("block", F.floor(F.col("start") / block_size)).withColumn("slot_offset", F.col("start") - F.col("block") * block_size)
    last = sums.groupBy("key").agg(F.sum("size").alias("size"))  # a document starts before its source's last byte
    if weights is None:
        target = last.withColumn("weight", _power(F.col("size"), power))
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"), "weight").groupBy("key").agg(F.sum("weight").alias("weight"))
        target = last.join(given, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)).cast("double"))
    plan = pfair_plan(target.select("key", "weight", (F.floor((F.col("size") - 1) / block_size) + 1).alias("n")), segment)
    return rows.join(plan, ["key", "block"]).select("doc_id", "source", "size", "block", "release", "deadline", "slot", "slot_offset", "text_hash")


def _power(size: Column, power: float) -> Column:
    """A square root is exact in every engine; other powers need not be."""
    return F.sqrt(size.cast("double")) if power == 0.5 else F.pow(size.cast("double"), F.lit(power))


def target_weights(docs: DataFrame, power: float = 0.5, text: str = "text", source: str = "source") -> DataFrame:
    """(source, weight): the default target of :func:`mix`, each source's bytes to the power ``power``."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    return docs.groupBy(F.col(source).cast("string").alias("source")).agg(_power(F.sum(size), power).alias("weight"))


def placed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with two more columns, slot and place in it in the order of :func:`mix`, and their names.

    Rows that repeat id and text all take the first place of these. The names are made such that no column clashes.
    """
    at = mix(docs, text=text, doc_id=doc_id, **options)
    at = at.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.min(F.struct("slot", "slot_offset")).alias("place"))
    at = written(at, "places")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("row_id"), F.xxhash64(text).alias("row_hash"))
    rows = rows.join(at, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")))
    slot, place = unused(docs, "slot"), unused(docs, "place")
    return rows.select("row.*", F.col("place.slot").alias(slot), F.col("place.slot_offset").alias(place)), slot, place


def in_mixed_order(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in the order of :func:`mix`: ranges of slots are partitions, sorted within. All columns and
    rows stay, nulls and repeats included; an empty table gives an empty result."""
    rows, slot, place = placed(docs, text, doc_id, **options)
    return rows.repartitionByRange(slot, doc_id).sortWithinPartitions(slot, place, doc_id).select(*[F.col(f"`{c}`") for c in docs.columns])


def from_files(docs: DataFrame) -> bool:
    """Whether ``docs`` are rows of Parquet files as read, so that each still has its place in them."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def file_order(docs: DataFrame, slot_bytes: int = 16_384, run: int = 1024, text: str = "text") -> tuple[DataFrame, str, str]:
    """The rows of ``docs``, which must be :func:`from_files`, with slot and place: the order that the files keep, by the
    number in a file's name and the row's in it; and the names of these columns.

    A slot is some ``slot_bytes`` bytes of the order: exact sums of ``run`` rows, and even parts of them within. Only a row
    per run is sent to every task, texts do not move.
    """
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.lit(0))
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), part.alias("part"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("at"), F.floor(F.col("_metadata.row_index") / run).alias("run"), size.alias("size"))
    runs = written(rows.groupBy("part", "file", "run").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "runs")
    files = runs.groupBy("part", "file").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    w = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")])
    w = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("bytes").over(w), F.lit(0))).join(F.broadcast(files), "file")
    rows = rows.drop("part").join(F.broadcast(runs.drop("part")), ["file", "run"])
    slot, place = unused(docs, "slot"), unused(docs, "place")
    inside = (F.col("at") - F.col("run") * run) * F.col("bytes") / F.col("n")
    return rows.select("row.*", F.floor((F.col("bytes_before") + F.col("base") + inside) / slot_bytes).alias(slot), (F.col("n_before") + F.col("at")).alias(place)), slot, place


def weights_of_order(rows: DataFrame, place: str, least: int = 16_384, text: str = "text", source: str = "source") -> dict[str, float]:
    """The weight of each source (null: the empty string) that the order by ``place`` shows: its bytes, by those that the
    source which ends last has until this one's end (one block, ``least``, if it has less). A row per source is collected."""
    r = rows.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(place).alias("place"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("size"))
    ends = sorted(r.groupBy("source").agg(F.max("place").alias("end"), F.sum("size").alias("size")).collect(), key=lambda x: x.end)
    if not ends:
        return {}
    before = F.size(F.filter(F.lit([x.end for x in ends]), lambda e: e < F.col("place")))  # ends that lie before
    sums = {x.i: x.size for x in r.where(F.col("source") == ends[-1].source).groupBy(before.alias("i")).agg(F.sum("size").alias("size")).collect()}
    out, so_far = {}, 0
    for i, x in enumerate(ends):
        so_far += sums.get(i, 0)
        out[x.source] = x.size / max(so_far, least) if i + 1 < len(ends) else 1.0
    return out


#: The same in DuckDB, for the defaults: one run over all slots, step by step. {docs} is the table.
MIX_SQL = """
with recursive d as (
  select doc_id, source, strlen(coalesce(text, '')) + 1 as size, coalesce('s' || source, 'n') as key from {docs}),
b as (select *, coalesce((((doc_id % 1000003) + 1000003) % 1000003 * 7919) % 4096, 0) as bucket from d),
p as (select *, coalesce(sum(size) over (partition by key order by bucket, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from b),
t as (select key, sqrt(sum(size)::double) as weight, ((sum(size) - 1) // 16384 + 1)::bigint as n from d group by key),
s as (select row_number() over (order by key) as i, key, n, greatest(1, floor(weight * pow(2, 40 - round(log2(max(weight) over ()))) + 0.5))::hugeint as w from t),
k as (select i, w, unnest(range(0, n + 1)) as k from s),
v as (select k.i, k.k, k.w, sum(least(k.k::hugeint * s.w, s.n::hugeint * k.w))::hugeint as served from k, s group by k.i, k.k, k.w),
q as (select a.i, a.k, (a.served // a.w)::bigint as release, ((z.served + a.w - 1) // a.w)::bigint as deadline from v a join v z on a.i = z.i and z.k = a.k + 1),
run as (
  select 0::bigint as t, list_transform(range(0, (select count(*) from s)), lambda x: 0::bigint) as done, 0::bigint as i
  union all
  select t + 1, list_transform(done, lambda x, j: x + (j = pick)::int), pick
  from (select r.t, r.done, (select arg_min(q.i, [q.deadline, q.i]) from q where q.k = r.done[q.i] and q.release <= r.t) as pick
        from run r where r.t < (select sum(n) from s))),
plan as (select s.key, run.i, t - 1 as slot, row_number() over (partition by run.i order by t) - 1 as k from run join s on s.i = run.i where t > 0)
select p.doc_id, p.source, p.size::bigint as size, q.k as block, q.release, q.deadline, plan.slot::bigint as slot, (p.start % 16384)::bigint as slot_offset
from p join plan on plan.key = p.key and plan.k = p.start // 16384 join q on q.i = plan.i and q.k = plan.k
"""
