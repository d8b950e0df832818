"""Near duplicates by circulant MinHash, banding and exact verification on full shingle sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialworks.operators.components import connected_components
from trialworks.storage import written

#: Universe of the permutations, as a power of two.
UNIVERSE_BITS = 22
REMEMBERED = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where it has fewer words.

    A-Z are lower-cased; words are separated by the six ASCII white characters.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(a) < k:
        k = len(a)
    h = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - k + 1 + i]
    return np.unique(mixed(h))


@lru_cache(2)
def shifted_permutation(coordinates: int, seed: int) -> np.ndarray:
    """Row i holds pi(i), pi(i + 1), ... around the circle: the values of all shifts of pi at i. A view, not a table."""
    pi = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """MinHash coordinates from two permutations: sigma places a shingle, and the k-th shift of pi ranks it for the k-th.

    Each shingle reads one contiguous run of pi, so all coordinates cost a row copy and a row minimum.
    """
    size = np.uint64((1 << UNIVERSE_BITS) - 1)
    at = ((shingles & size) * np.uint64(2_654_435_769) + np.uint64(seed)) & size  # sigma
    rows, out = shifted_permutation(coordinates, seed), np.full(coordinates, np.iinfo(np.int32).max, np.int32)
    for i in range(0, len(at), 1024):
        np.minimum(out, rows[at[i : i + 1024].astype(np.int64)].min(0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    s = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(s) + 1, dtype=np.uint64)
    for i in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return h.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (an order-free 128-bit digest of the set), keys (one a band), low (8 bits a coordinate)."""

    def run(batches):
        import pyarrow as pa

        words = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, n, d1, d2, keys, low = b.slice(at, 256), [], [], [], [], []
                for t in part.column("text").to_pylist():
                    s = shingle_set(t, k, words)
                    n.append(len(s))
                    d1.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(0x14057B7EF767814F))).astype(np.int64)) if len(s) else 0)
                    sig = signature(s, bands * rows) if len(s) else None
                    keys.append(None if sig is None else band_keys(sig, rows))
                    low.append(None if sig is None else sig.astype(np.uint8).tobytes())
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "keys", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>, low binary")


def _agreement(a: Column, b: Column) -> Column:
    """Estimated similarity: the share of equal coordinates, without those that 8 bits make equal by chance."""

    @F.pandas_udf(T.DoubleType())
    def share(x, y):
        import pandas as pd

        same = [np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)) for p, q in zip(x, y)]
        return pd.Series([(s - 1 / 256) / (1 - 1 / 256) for s in same], dtype="float64")

    return share(a, b)


def _linked(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union of the texts' full shingle sets."""

    @F.pandas_udf(T.BooleanType())
    def check(x, y):
        import pandas as pd

        sets, out = HubSets(k), []
        for p, q in zip(x, y):
            s, t = sets[p], sets.of(q)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype="bool")

    return check(a, b)


class HubSets(dict):
    """Shingle sets of hubs, kept for their runs of pairs."""

    def __init__(self, k: int):
        super().__init__()
        self.k, self.words = k, WordHashes()

    def of(self, text: str) -> np.ndarray:
        return shingle_set(text, self.k, self.words)

    def __missing__(self, text: str) -> np.ndarray:
        if len(self) > 64:
            self.clear()
        self[text] = s = self.of(text)
        return s


def _apart(hub: Column, text: Column, k: int) -> Column:
    """struct(n_hub, less, more, tokens): the hub's set size, how many of its shingles a text lacks, how many it has besides, and all of these."""

    @F.pandas_udf("struct<n_hub: long, less: long, more: long, tokens: array<long>>")
    def run(x, y):
        import pandas as pd

        sets, rows = HubSets(k), []
        for p, q in zip(x, y):
            s, t = sets[p], sets.of(q)
            less, more = np.setdiff1d(s, t, assume_unique=True), np.setdiff1d(t, s, assume_unique=True)
            rows.append((len(s), len(less), len(more), np.concatenate([less, more]).view(np.int64)))
        return pd.DataFrame(rows, columns=["n_hub", "less", "more", "tokens"])

    return run(hub, text)


def _between(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) certain links and (a, b) pairs to confirm among the members of each hub's group, for labels that differ.

    ``groups`` (hub, rep, label, n_hub, less, more, tokens), with hub and rep as struct(id, hash of the text), tells a member by what separates it from the hub. For members x, y of
    a group with hub H the intersection is |H| - less(x) - less(y) + (tokens that x and y share), so with
    phi = percent * size + (100 + percent) * less they are linked when (100 + percent) * shared >= phi(x) + phi(y) -
    (100 + percent) * |H|. Where that is zero or less the link is certain, and as it holds for x and the member of least
    phi whenever it holds for x and any other, only pairs with that member are made. Otherwise x and y must share that many
    tokens: tokens that no other member has are left out, members that have too few tokens left for any partner go, and
    the others meet where the rarest of their tokens do (prefix filter: all but the needed number less one).
    """
    unit = 100 + percent
    size = F.col("n_hub") - F.col("less") + F.col("more")
    g = groups.withColumn("phi", percent * size + unit * F.col("less") - unit * F.col("n_hub") / 2)  # half of |H| each
    most = g.groupBy("hub", "label").agg(F.count("*").alias("c")).groupBy("hub").agg(F.max(F.struct("c", "label"))["label"].alias("largest"))
    least = g.groupBy("hub").agg(F.min(F.struct("phi", "rep", "label")).alias("least"))
    sure = g.join(least, "hub").where((F.col("label") != F.col("least.label")) & (F.col("phi") + F.col("least.phi") <= 0))
    sure = sure.select(F.least("rep.id", "least.rep.id").alias("a"), F.greatest("rep.id", "least.rep.id").alias("b")).distinct()
    t = g.select("hub", "rep", F.explode("tokens").alias("token"))
    df = t.groupBy("hub", "token").agg(F.count("*").alias("df")).where("df > 1")
    own = t.join(df, ["hub", "token"]).groupBy("hub", "rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    d = g.drop("tokens").join(own, ["hub", "rep"]).join(most, "hub").withColumn("out", F.col("label") != F.col("largest")).withColumn("d", F.size("own"))
    d = written(d, "separated")

    def needed(x: DataFrame, low: DataFrame) -> DataFrame:
        x = x.join(low, "hub").withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("phi") + F.col("low")) / unit - 1e-9)))
        return x.where("need <= d").drop("low")

    outside = needed(d.where("out"), d.groupBy("hub").agg(F.min("phi").alias("low")))
    inside = needed(d, outside.groupBy("hub").agg(F.min("phi").alias("low")))
    prefix = lambda x: x.withColumn("token", F.explode(F.slice("own", F.lit(1), F.col("d") - F.col("need").cast("int") + 1))).withColumn("token", F.col("token.token"))
    x, y = prefix(outside).alias("x"), prefix(inside).alias("y")
    once = ~F.col("y.out") | (F.col("x.rep") < F.col("y.rep"))
    enough = F.least("x.d", "y.d") * unit >= F.col("x.phi") + F.col("y.phi") - 1e-6
    pairs = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & once & enough)
    return sure, pairs.select(F.least("x.rep.id", "y.rep.id").alias("a"), F.greatest("x.rep.id", "y.rep.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, margin: float = 0.16, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their sets of k-word shingles meet 100 * intersection >= percent * union; a component
    is what links reach, named by its least id, which is the one kept.

    Documents with equal sets are one class. Class representatives are sketched by circulant MinHash; with 42 bands of 6
    rows a pair at similarity 0.8 shares a bucket but for about 3 in a million, a closer one more surely still. First
    each bucket's members are checked against its hub only, the member that meets most others over all buckets, and the
    confirmed links are closed to components. Where the members that met one hub are still in several components, the
    pairs between these that can be linked are found from what separates each member from the hub (:func:`_between`,
    exact), and confirmed. Links are confirmed on the full sets of the whole texts. No group is capped.

    Empty and null texts have no shingles and are linked with nothing. Rows with a null id are never linked: their
    component is null and they are kept. Rows repeating an id are one node, with the links of all their texts. An empty
    table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sk = written(sketches(base, k, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    digest = ["n", "d1", "d2"]
    first = sk.where("n > 0 and doc_id is not null").groupBy(*digest).agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    first = written(first.select(*digest, "rep.doc_id", "rep.row").withColumnRenamed("doc_id", "rep"), "classes")
    reps = sk.join(first.select("row", "rep"), "row").select("rep", "n", "keys", "low", "row")
    members = sk.select("doc_id", *digest).join(first.drop("row"), digest, "left")
    reps = written(reps.drop("row"), "representatives")

    hits = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = hits.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    hits = written(hits.join(shared, "key"), "buckets")
    met = hits.groupBy("rep").agg(F.sum("m").alias("met"))
    hits = hits.join(met, "rep").select("key", "rep", "n", "met")
    hubs = hits.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("less"), "n")).alias("h")).select("key", (-F.col("h.less")).alias("hub"), F.col("h.n").alias("n_hub"))
    star = hits.join(hubs, "key").where("rep <> hub").select("hub", "rep", "n", "n_hub").distinct()
    star = written(star, "stars")
    fits = F.least("n", "n_hub") * 100 >= F.greatest("n", "n_hub") * percent
    texts = written(base.join(hits.select("rep").distinct(), base.doc_id == F.col("rep"), "left_semi"), "texts")  # all texts of a repeated id
    low = reps.select("rep", "low")

    def with_texts(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.join(texts.toDF(a, "text_a"), a).join(texts.toDF(b, "text_b"), b)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return with_texts(pairs, "a", "b").where(_linked(F.col("text_a"), F.col("text_b"), k, percent)).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    likely = star.where(fits).select(F.col("hub").alias("a"), F.col("rep").alias("b")).join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b")
    likely = likely.where(_agreement(F.col("low_a"), F.col("low_b")) >= percent / 100 - margin).select("a", "b")
    same_id = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("all")).where("size(all) > 1")
    same_id = same_id.select("src", F.explode("all").alias("dst")).where("src <> dst")
    links = written(confirmed(likely).unionByName(same_id), "links")
    component = connected_components(links)

    label = component.withColumnRenamed("id", "rep")
    named = star.select("hub", "rep").unionByName(star.select("hub", F.col("hub").alias("rep")).distinct())
    named = written(named.join(label, "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("label")), "named")
    several = named.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("hub")
    open_ = with_texts(named.join(several, "hub"), "hub", "rep")
    node = lambda i, t: F.struct(F.col(i).alias("id"), F.xxhash64(t).alias("text")).alias(i)
    open_ = open_.select(node("hub", "text_a"), node("rep", "text_b"), "label", _apart(F.col("text_a"), F.col("text_b"), k).alias("x"))
    sure, pairs = _between(written(open_.select("hub", "rep", "label", "x.*"), "open-groups"), percent)
    more = written(confirmed(pairs).unionByName(sure.toDF("src", "dst")), "links")
    if not more.isEmpty():
        component = connected_components(component.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(more))

    out = members.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

