"""Duplicate audits: exact and loose copies, character shingles, MinHash bands, verified near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialworks.functions import text as X
from trialworks.operators.components import connected_components
from trialworks.storage import written

PRIME = (1 << 31) - 1


def duplicate_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows, distinct texts and surplus copies under the exact and the loose normaliser."""
    def one(name: str, norm: Column) -> DataFrame:
        groups = docs.select(norm.alias("k")).groupBy("k").count()
        return groups.agg(F.lit(name).alias("normaliser"), F.sum("count").alias("n_rows"), F.count("*").alias("distinct_texts"), F.sum(F.col("count") - 1).alias("surplus"))

    return one("exact", X.norm_exact(F.col(text))).union(one("loose", X.norm_loose(F.col(text))))


def shingle_set(t: str, k: int = 5) -> set[str]:
    """Distinct k-grams of a loose text; a short text is its own, an empty one has none."""
    return {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else ({t} if t else set())


def similarities(x, y, k: int) -> list[float]:
    """Of each pair of texts. One pair's sets are held at a time: those of a whole batch take gigabytes."""
    import numpy as np

    from trialworks.functions.shingles import codes

    out, last, s = [], None, None
    for p, q in zip(x, y):
        if p != last:
            last, s = p, codes(p, k)
        t = codes(q, k)
        if s is None or t is None:
            s_, t_ = shingle_set(p, k), shingle_set(q, k)
            both, n = len(s_ & t_), len(s_) + len(t_)
        else:
            all_ = np.sort(np.concatenate([s, t]))
            both, n = int((all_[1:] == all_[:-1]).sum()), len(all_)
        out.append(both / max(1, n - both))
    return out


def jaccard(a: Column, b: Column, k: int = 5) -> Column:
    """Similarity of two loose texts' k-gram sets; 0 where both are empty."""

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        return pd.Series(similarities(x, y, k), dtype="float64")

    return run(a, b)


def hash_parameters(n: int, seed: int = 17) -> list[tuple[int, int]]:
    import random

    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(n)]


def sketch(t: Column, n: int = 64, k: int = 5) -> Column:
    """(m, size, bins) of a loose text's k-grams. ``m``: minima of (a h + b) mod P over their hashes, zeros for none; products
    stay below 2^63. ``size``: how many differ. ``bins``: how many fall into each of some size / 8 bins, a byte each, and
    before them how many the bytes had no room for."""
    params = hash_parameters(n)

    @F.pandas_udf("m array<long>, size long, bins binary")
    def run(texts):
        import pandas as pd

        from trialworks.functions.shingles import sketches

        m, size, bins = sketches([t.encode() for t in texts], params, k)
        return pd.DataFrame({"m": list(m), "size": size, "bins": bins})

    return run(t)


def most_shared(a: bytes, b: bytes) -> int:
    """No fewer k-grams than two texts share, from their bins: equal ones fall into the same bin."""
    import numpy as np

    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    least = min(len(x), len(y))  # both lengths are powers of two: the bins of the longer are folded
    x, y = (z if len(z) == least else z.reshape(-1, least).sum(0) for z in (x, y))
    return int(np.minimum(x, y).sum()) + min(int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little"))


def _sketched(docs: DataFrame, n: int, bands: int, k: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, t, digest) of each document, ``t`` its loose text and ``digest`` the hash of it, null for none; and
    (digest, row, id, size, bins, keys) of each class of equal loose texts, named by its least id and standing at a row of it."""
    params, per = hash_parameters(n), n // bands

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        from trialworks.functions.shingles import loose, sketches

        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = loose(b.column("t"))
                m, size, bins = sketches(texts, params, k)
                m = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), n).cast(pa.list_(pa.int64()))
                columns = [b.column("id"), b.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([blake2b(t, digest_size=16).digest() if t else None for t in texts], pa.binary()), m, pa.array(size), pa.array(bins, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "t", "digest", "m", "size", "bins"])

    rows = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), F.lower(F.col(text)).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"id {kind}, row long, t string, digest binary, m array<long>, size long, bins binary")
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("m", i * per + 1, per)) for i in range(bands)])
    rows = written(rows.select("id", "row", "t", "digest", "size", "bins", keys.alias("keys")), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    same = [F.first(c).alias(c) for c in ("size", "bins", "keys")]  # they depend on the text alone
    classes = rows.where("digest is not null").groupBy("digest").agg(least, *same)
    return rows.select("id", "row", "t", "digest"), written(classes.select("digest", "least.row", "least.id", "size", "bins", "keys"), "classes")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, row, size, c, hub) of the classes in each bucket of ``c`` > 1; ``hub`` is one of them."""
    hits = classes.where("id is not null").select("row", "size", F.explode("keys").alias("key"))
    return hits.join(hits.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("hub")).where("c > 1"), "key")


def _meeting(hits: DataFrame, similarity: float, block: int = 4096) -> DataFrame:
    """(a, b), a < b, of all rows of a bucket that may reach ``similarity`` by their sizes and bins (:func:`most_shared`),
    differ in ``label``, and of which at least one has ``meet``. ``hits``: key, c, row, size, bins, label, meet.

    A bucket's rows are compared where they lie, as arrays; a bucket of more than ``block`` rows is cut into blocks, and
    each two of them meet in a group of their own.
    """
    parts = F.ceil(F.col("c") / block).cast("int")
    d = hits.withColumn("own", F.pmod(F.xxhash64("row"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    d = d.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "row", "size", "bins", "label", "meet")
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work grows with a bucket's square
    d = d.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q", "size")

    def run(batches):
        import pyarrow as pa

        from trialworks.functions.shingles import Bucket

        held = None
        for b in (b for b in batches if b.num_rows):
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            at = Bucket.starts(t)[-1]  # the last group may go on
            if at:
                yield from Bucket(t.slice(0, at), similarity).pairs()
            held = t.slice(at)
        if held is not None:
            yield from Bucket(held, similarity).pairs()

    return d.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b, similarity) of the pairs of rows that reach it."""
    t = rows.select("row", "t")
    found = pairs.join(t.toDF("b", "tb"), "b").join(t.toDF("a", "ta"), "a").withColumn("similarity", jaccard(F.col("ta"), F.col("tb"), k))
    return found.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with ids in place of rows, the lesser first."""
    ids = classes.select("row", "id")
    p = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def near_duplicate_pairs(docs: DataFrame, similarity: float = 0.8, n: int = 64, bands: int = 16, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, b, similarity) of all pairs of distinct loose texts that share a band bucket and verify, a < b.

    Equal loose texts are one class, named by its least id. All members of a bucket meet, but for those whose sizes or
    bins rule the similarity out, so the pairs of a group of near copies grow with its square, as the result does;
    :func:`near_duplicate_clusters` closes the same links without making them all.
    """
    rows, classes = _sketched(docs, n, bands, k, text, doc_id)
    hits = _buckets(classes).join(classes.select("row", "bins"), "row").select("key", "c", "row", "size", "bins", F.col("row").alias("label"), F.lit(True).alias("meet"))
    return _named(_verified(written(_meeting(hits, similarity), "pairs"), rows, similarity, k), classes)


def _links(rows: DataFrame, classes: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b) with the same components as the pairs of :func:`near_duplicate_pairs`.

    First a bucket's members meet one of them only, its hub, and the links found are closed. Then, in buckets whose
    members are still in several components, the members outside the largest one meet those of other components; the
    rest of the pairs would link texts that are together already. No bucket is capped.
    """
    bins = classes.select("row", "bins")
    hits = written(_buckets(classes), "buckets")
    star = hits.join(bins, "row").select("key", "c", "row", "size", "bins", F.col("row").alias("label"), (F.col("row") == F.col("hub")).alias("meet"))
    star = written(_meeting(star, similarity), "stars")
    links = written(_verified(star, rows, similarity, k).select("a", "b"), "links")
    component = connected_components(links, "a", "b").withColumnRenamed("id", "row")
    named = written(hits.join(component, "row", "left").select("key", "c", "row", "size", F.coalesce("component", "row").alias("label")), "labels")
    several = named.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label"))["label"].alias("largest")).where("labels > 1")
    open_ = named.join(several.select("key", "largest"), "key").join(bins, "row").select("key", "c", "row", "size", "bins", "label", (F.col("label") != F.col("largest")).alias("meet"))
    pairs = written(_meeting(open_, similarity).join(star, ["a", "b"], "left_anti"), "pairs")
    return _named(links.unionByName(_verified(pairs, rows, similarity, k).select("a", "b")), classes)


def near_duplicate_clusters(docs: DataFrame, similarity: float = 0.8, n: int = 64, bands: int = 16, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, component) over all rows: near-duplicate links closed, copies of a class included, single rows too."""
    rows, classes = _sketched(docs, n, bands, k, text, doc_id)
    component = connected_components(_links(rows, classes, similarity, k), "a", "b")
    named = rows.select("id", "digest").join(classes.select("digest", F.col("id").alias("rep")), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return named.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))


def cluster_report(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("component").count()
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("count") == 1).alias("singletons"), F.count_if(F.col("count") > 1).alias("multi"),
                     F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("rows_in_multi"), F.max("count").alias("largest"))


def source_collapse(clusters: DataFrame, by: str = "source") -> DataFrame:
    return clusters.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("component").alias("clusters")).withColumn("collapse", 1 - F.col("clusters") / F.col("n"))
