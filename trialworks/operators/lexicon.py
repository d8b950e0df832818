"""Word ratings: statistics of a lexicon, and features of texts from the ratings of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialworks.functions import text as X
from trialworks.storage import written

DIMENSIONS = ["valence", "arousal", "dominance", "concreteness"]
#: Pairs of segments whose ratings are compared: gender, age, education.
SEGMENTS = {"gender": ("m", "f"), "age": ("y", "o"), "edu": ("l", "h")}
#: A lexicon of at most so many words is broadcast; a larger one is joined by shuffling.
BROADCAST_WORDS = 200_000


def read_norms(rows: DataFrame) -> DataFrame:
    """Ratings as numbers under lower-case words: a word needs valence, arousal and dominance; ratings to three places."""
    cols = [F.round(F.col(c).try_cast("double"), 3).alias(c) for c in rows.columns if c != "word"]
    out = rows.select(F.lower(F.trim("word")).alias("word"), *cols)
    return out.where((F.col("word") != "") & F.col("valence").isNotNull() & F.col("arousal").isNotNull() & F.col("dominance").isNotNull()).dropDuplicates(["word"])


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """(dimension, mean, sd) over all words that have it; the population's sd."""
    long = lexicon.select("word", *DIMENSIONS).unpivot(["word"], DIMENSIONS, "dimension", "value").where("value is not null")
    return long.groupBy("dimension").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def vocab_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many words both have."""
    return a.select("word").distinct().join(b.select("word").distinct(), "word", "left_semi").agg(F.count("*").alias("shared"))


def segment_gap_stats(lexicon: DataFrame) -> DataFrame:
    """(pair, dimension, mean, sd, wide, effect) of the differences between two segments' ratings of a word."""
    rows = [F.struct(F.lit(p).alias("pair"), F.lit(d).alias("dimension"), (F.col(f"{d}_{a}") - F.col(f"{d}_{b}")).alias("diff")) for p, (a, b) in SEGMENTS.items() for d in ("valence", "arousal")]
    long = lexicon.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("diff is not null")
    g = long.groupBy("pair", "dimension").agg(F.avg("diff").alias("mean"), F.stddev_pop("diff").alias("sd"), F.avg((F.abs("diff") > 0.3).cast("double")).alias("wide"))
    sd = lexicon_stats(lexicon).select("dimension", F.col("sd").alias("all_sd"))
    return g.join(F.broadcast(sd), "dimension").select("pair", "dimension", "mean", "sd", "wide", (F.col("mean") / F.col("all_sd")).alias("effect"))  # four rows


def rated(docs: DataFrame, lexicon: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per content word and document, with its place, the number of such words and the word's ratings (null: none)."""
    words = docs.select(F.col(doc_id).alias("doc_id"), X.content_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    words = words.select("doc_id", F.size("w").alias("looked_up"), F.posexplode_outer("w").alias("at", "word"))
    small = lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return words.join(F.broadcast(lexicon) if small else lexicon, "word", "left")


#: Words of a slice of a lexicon that a task holds; rows of copies of all slices, four copies of each at least.
SLICE_WORDS, COPIED_WORDS = 400_000, 2_000_000


def word_counts(docs: DataFrame, slices: int, pieces: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, slice, piece, looked_up, first, last, words, n): the content words of a document that fall into a slice, each
    once, with their counts; ``first`` and ``last`` where the text's own first and last one does. A document has a row at least."""

    def run(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        token, stop, known, at = re.compile(X.TOKEN), set(X.STOPWORDS), {}, 0
        for b in batches:
            of, rows, ends, words, counts = [], [], [0], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                all_ = token.findall(t)
                kept = [w for w in all_ if w not in stop] or all_
                parts: dict[int, list] = {}
                for w, n in Counter(kept).items():
                    if (k := known.get(w)) is None:
                        if len(known) >= 500_000:
                            known.clear()
                        k = known[w] = crc32(w.encode()) % slices
                    parts.setdefault(k, []).append((w, n))
                ends_in = [known.get(w, crc32(w.encode()) % slices) for w in (kept[0], kept[-1])] if kept else (None, None)
                at += 1
                for k, found in (parts or {0: []}).items():
                    of.append(i)
                    rows.append((k, at % pieces, len(kept), kept[0] if k == ends_in[0] else None, kept[-1] if k == ends_in[1] else None))
                    words += [w for w, _ in found]
                    counts += [n for _, n in found]
                    ends.append(len(words))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()))]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((words, pa.string()), (counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), *cols, *lists], ["doc_id", "slice", "piece", "looked_up", "first", "last", "words", "n"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, slice int, piece int, looked_up long, first string, last string, words array<string>, n array<int>")


def lexicon_features(docs: DataFrame, lexicon: DataFrame, text: str = "text", doc_id: str = "doc_id", slice_words: int = SLICE_WORDS) -> DataFrame:
    """Arousal, valence, dominance, concreteness and segment features of each document; 0 where no word is rated.

    z's are against the lexicon's mean and spread. Texts of any length are read whole; a null text has no words. A lexicon has a
    row a word, of any number: it is cut into slices of some ``slice_words``, the counts of a document's words go to their
    slices, and sums, ends and the three largest ratings come back, so neither a word's ratings nor a text move.
    """
    rated_by = [*DIMENSIONS, *[f"{d}_{s}" for p in SEGMENTS.values() for s in p for d in ("valence", "arousal")]]
    lexicon = written(lexicon.select("word", *[F.col(c).cast("double").alias(c) for c in rated_by]).where("word is not null"), "lexicon")
    stats = {r.dimension: (r["mean"], r.sd or 1.0) for r in lexicon_stats(lexicon).collect()}  # four rows
    size = lexicon.count()
    slices, tasks = max(1, -(-size // slice_words)), int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(-(-tasks // slices), max(4, COPIED_WORDS // max(1, size)))
    mids = [stats.get(d, (0.0, 1.0))[0] for d in DIMENSIONS]
    kind = F.lit(1).alias("kind")
    texts = word_counts(docs, slices, pieces, text, doc_id).select("slice", "piece", kind, "doc_id", "looked_up", "first", "last", "words", "n", F.lit(None).cast("array<double>").alias("ratings"))
    copies = lexicon.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(0).alias("kind"),
                            F.lit(None).cast(dict(texts.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("looked_up"), F.col("word").alias("first"), F.lit(None).cast("string").alias("last"),
                            F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<int>").alias("n"), F.array(*rated_by).alias("ratings"))
    both = copies.unionByName(texts).repartition(tasks, "slice", "piece").sortWithinPartitions("slice", "piece", "kind")
    sums = [f"{p}_{c}" for p in ("sum", "count") for c in rated_by] + [f"sq_{d}" for d in DIMENSIONS] + ["pos", "neg", "high", "low", "ext"]
    least, most = [f"min_{d}" for d in DIMENSIONS], [f"max_{d}" for d in DIMENSIONS] + ["extremity", "first", "last"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cell, words, ratings, table, value = None, [], [], None, None
        for whole in batches:
            of = [whole.column(c).to_numpy() for c in ("slice", "piece", "kind")]
            new = np.ones(whole.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in of], 0)
            cuts = [*np.flatnonzero(new), whole.num_rows]
            for b in (whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:])):
                here = (b.column("slice")[0].as_py(), b.column("piece")[0].as_py())
                if here != cell:
                    cell, words, ratings, table = here, [], [], None
                if b.column("kind")[0].as_py() == 0:
                    words.append(b.column("first"))
                    flat = b.column("ratings").flatten()
                    ratings.append([x.to_numpy(zero_copy_only=False).reshape(-1, len(rated_by)) for x in (flat.fill_null(0.0), flat.is_valid())])
                    continue
                if table is None:  # all of the slice's words came before
                    table = pa.concat_arrays(words) if words else pa.array([], pa.string())
                    ratings.append((np.zeros((1, len(rated_by))), np.zeros((1, len(rated_by)), bool)))  # a word that is not rated
                    value, ratings = [np.concatenate(x) for x in zip(*ratings)], []
                rows = b.num_rows
                sought = [b.column("words").flatten(), b.column("first"), b.column("last")]
                at = pc.index_in(pa.concat_arrays(sought), value_set=table).fill_null(len(table)).to_numpy(zero_copy_only=False)
                at, *ends = np.split(at, np.cumsum([len(x) for x in sought[:2]]))
                n = b.column("n").flatten().to_numpy(zero_copy_only=False).astype(float)
                row = np.repeat(np.arange(rows), b.column("words").value_lengths().to_numpy(zero_copy_only=False))
                row, n, at = (x[at < len(table)] for x in (row, n, at))
                total = lambda x: np.bincount(row, x, rows)
                out, col = {}, {}
                for i, c in enumerate(rated_by):
                    x, ok = value[0][at, i], value[1][at, i]
                    out[f"sum_{c}"], out[f"count_{c}"], col[c] = total(n * x), total(n * ok), (x, ok)
                for d, mid in zip(DIMENSIONS, mids):
                    x, ok = col[d]
                    out[f"sq_{d}"] = total(n * ok * (x - mid) ** 2)
                    for name, f, none in ((f"min_{d}", np.minimum, np.inf), (f"max_{d}", np.maximum, -np.inf)):
                        out[name] = np.full(rows, none)
                        f.at(out[name], row[ok], x[ok])
                (v, v_ok), (c, c_ok) = col["valence"], col["concreteness"]
                out |= {"pos": total(n * (v_ok & (v > 6))), "neg": total(n * (v_ok & (v < 4))), "high": total(n * (c_ok & (c > 4))), "low": total(n * (c_ok & (c < 2)))}
                out["ext"], out["extremity"] = total(n * v_ok * np.abs(v - 5)), np.full(rows, -np.inf)
                np.maximum.at(out["extremity"], row[v_ok], np.abs(v - 5)[v_ok])
                for name, d, i in zip(("first", "last"), ("arousal", "valence"), ends):
                    out[name] = np.where(value[1][i, rated_by.index(d)], value[0][i, rated_by.index(d)], -np.inf)
                a, ok = col["arousal"]
                times = np.minimum(n[ok], 3).astype(int)
                r, a = np.repeat(row[ok], times), np.repeat(a[ok], times)
                order = np.lexsort((-a, r))
                r, a = r[order], a[order]
                ends = np.bincount(r, minlength=rows)
                top = np.arange(len(r)) - np.repeat(np.cumsum(ends) - ends, ends) < 3
                top = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(ends, 3))]), pa.int32()), pa.array(a[top]))
                numbers = [pa.array(out[c], mask=None if c in sums else ~np.isfinite(out[c])) for c in [*sums, *least, *most]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("looked_up"), *numbers, top], ["doc_id", "looked_up", *sums, *least, *most, "top"])

    id_kind = dict(texts.dtypes)["doc_id"]
    parts = both.mapInArrow(run, f"doc_id {id_kind}, looked_up long, " + ", ".join(f"{c} double" for c in [*sums, *least, *most]) + ", top array<double>")
    g = parts.groupBy("doc_id").agg(F.max("looked_up").alias("looked_up"), *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most],
                                    F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, 3).alias("top"))
    z = lambda d, c: (c - stats.get(d, (0.0, 1.0))[0]) / (stats.get(d, (0.0, 1.0))[1] or 1.0)
    some = lambda c: F.nullif(F.col(f"count_{c}"), F.lit(0.0))
    avg = lambda c: F.col(f"sum_{c}") / some(c)
    low, high = (lambda d: F.col(f"min_{d}")), (lambda d: F.col(f"max_{d}"))

    def sd(d: str) -> Column:
        mean = F.col(f"sum_{d}") / some(d) - mids[DIMENSIONS.index(d)]  # squares are sums around the lexicon's mean
        return F.when(low(d) == high(d), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col(f"sq_{d}") / some(d) - mean * mean)))

    out: dict[str, Column] = {}
    for d, name in (("arousal", "arousal"), ("valence", "valence"), ("concreteness", "concrete")):
        out |= {f"{name}_mean_z": z(d, avg(d)), f"{name}_sd": sd(d), f"{name}_max_z": z(d, high(d)), f"{name}_min_z": z(d, low(d))}
    out |= {f"{d}_range": high(d) - low(d) for d in ("arousal", "valence")} | {"valence_skew": avg("valence") - (low("valence") + high("valence")) / 2}
    out |= {"dominance_mean_z": z("dominance", avg("dominance")), "dominance_sd": sd("dominance")}
    out |= {"valence_pos_frac": F.col("pos") / some("valence"), "valence_neg_frac": F.col("neg") / some("valence"), "concrete_frac_high": F.col("high") / some("concreteness"), "concrete_frac_low": F.col("low") / some("concreteness")}
    out |= {"extremity_mean": F.col("ext") / some("valence"), "extremity_max": F.col("extremity")}
    out |= {"first_word_arousal_z": z("arousal", F.col("first")), "last_word_valence_z": z("valence", F.col("last"))}
    out |= {f"{n}_coverage": F.col(f"count_{c}") / F.greatest(F.col("looked_up"), F.lit(1)) for n, c in (("vad", "valence"), ("conc", "concreteness"))}
    out |= {f"{d}_{p}_gap": avg(f"{d}_{s}") - avg(f"{d}_{t}") for p, (s, t) in SEGMENTS.items() for d in ("valence", "arousal")}
    out["arousal_top3_z"] = z("arousal", F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("top"), F.lit(0)))
    return g.select("doc_id", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.items()])


def segment_shift(docs: DataFrame, lexicon: DataFrame, least: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(pair, texts, mean_shift, max_shift, wide): how differently two segments rate whole texts, over words rated by both."""
    words = rated(docs, lexicon, text, doc_id)
    rows = [F.struct(F.lit(p).alias("pair"), (F.col(f"valence_{a}") - F.col(f"valence_{b}")).alias("diff")) for p, (a, b) in SEGMENTS.items()]
    per = words.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*").where("diff is not null")
    per = per.groupBy("doc_id", "pair").agg(F.count("*").alias("n"), F.abs(F.avg("diff")).alias("shift")).where(F.col("n") >= least)
    return per.groupBy("pair").agg(F.count("*").alias("texts"), F.avg("shift").alias("mean_shift"), F.max("shift").alias("max_shift"), F.avg((F.col("shift") > 0.3).cast("double")).alias("wide"))


# The eight emotions and the two sentiments of a word-emotion table.
EMOTIONS = "anger anticipation disgust fear joy sadness surprise trust".split()
SENTIMENTS = "negative positive".split()


def frequency_features(docs: DataFrame, frequencies: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mean, least and spread of the content words' Zipf frequencies and the shares of rare and common ones; words that
    ``frequencies`` (word, zipf) lacks or gives 0 do not count, a document without any has zeros."""
    words = rated(docs, frequencies.where("zipf > 0"), text, doc_id)
    z = F.col("zipf")
    share = lambda cond: F.count_if(cond) / F.nullif(F.count(z), F.lit(0))
    out = {"zipf_mean": F.avg(z), "zipf_min": F.min(z), "zipf_sd": F.stddev_pop(z), "rare_word_frac": share(z < 3), "common_word_frac": share(z > 5)}
    return words.groupBy("doc_id").agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.items()])


def emotion_features(docs: DataFrame, emotions: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shares of the content words that carry each emotion and sentiment, how many emotions occur, the share of the most
    frequent one, and negative less positive. ``emotions`` (word, tags) is a row per word with an array of tags."""
    words = rated(docs, emotions, text, doc_id)
    n = F.greatest(F.max("looked_up"), F.lit(1))
    hits = {e: F.count_if(F.array_contains("tags", e)) for e in [*EMOTIONS, *SENTIMENTS]}
    g = words.groupBy("doc_id").agg(n.alias("n"), *[c.alias(e) for e, c in hits.items()])
    kinds = [F.col(e) for e in EMOTIONS]
    return g.select("doc_id", *[(F.col(e) / F.col("n")).alias(f"emo_{e}") for e in hits],
                    (sum((c > 0).cast("int") for c in kinds) / F.lit(float(len(kinds)))).alias("emo_diversity"),
                    (F.greatest(*kinds) / F.col("n")).alias("emo_intensity"), ((F.col("negative") - F.col("positive")) / F.col("n")).alias("emo_neg_minus_pos"))
