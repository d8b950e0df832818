"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialworks.storage import written

#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 14
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Scores are compared at this many steps to the unit.
STEPS = 500


def ngrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the text between two spaces, case and symbols kept."""
    b = np.frombuffer(b" " + text.encode() + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return h >> np.uint32(18)


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[bytes], codes: WordCodes) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    if len(codes) > 1 << 20:
        codes.clear()
    a = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    if len(codes) < 1 << 21:
        w = a[:-2] << 42 | a[1:-1] << 21 | a[2:]
    else:  # more words than 21 bits hold: number the pairs first
        two = np.unique(a[:-1] << 32 | a[1:], return_inverse=True)[1].astype(np.int64)
        w = two[:-1] << 32 | a[2:]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(w, twice))
    mark = np.zeros(len(a), bool)
    for k in range(3):
        mark[hit + k] = True
    return int(mark.sum())


def base_counts(text: str | None, codes: WordCodes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at just the six ASCII white characters
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(WHITE):
                dup += line in seen
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words, codes)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of a one-column table of texts. Each input split sends one row a bucket at most."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total += np.bincount(ngrams(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, trusted_rows: int = 20_000, smoothing: float = 1.0, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw): raw counts are those of all documents.

    ``trusted_ids`` is a one-column table of ids. The classifier's trusted side is fitted on the ``trusted_rows`` ids that
    hash lowest, a bound that lets them be broadcast so that no text is shuffled; rows that repeat such an id all count.
    Only the bucket counts (a fixed number) reach the driver.
    """
    ids = trusted_ids.toDF("id").distinct().orderBy(F.xxhash64("id"), "id").limit(trusted_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    trusted = rows.join(F.broadcast(ids), "id", "left_semi").select("text")  # at most trusted_rows ids
    rows = [ngram_counts(trusted).collect(), ngram_counts(rows.select("text")).collect()]
    logs = []
    for got in rows:
        n = np.full(BUCKETS, smoothing)
        for r in got:
            n[r.bucket] += r.n
        logs.append(np.log(n / n.sum()))
    return (logs[0] - logs[1]) if rows[0] else np.zeros(BUCKETS)


def measure(docs: DataFrame, ratio: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, and llr: the mean log ratio over the text's n-grams (0 for an empty text)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    weights = ratio.astype(np.float64)

    def run(batches):
        import pyarrow as pa

        codes = WordCodes()
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = [base_counts(t, codes) for t in texts]
            llr = [float(weights[ngrams(t)].mean()) if t else 0.0 for t in texts]
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(llr, pa.float64())], ["doc_id", *names, "llr"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", llr double")


def best_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The cut that best separates good from bad labelled documents: the largest sum of both shares kept right.

    Both tables have doc_id; scores meet the labels as (doc_id, llr) rows, and only counts per score step reach the
    driver. Ties go to the lowest cut, which keeps more. Without labels of both kinds everything is kept.
    """
    step = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("llr"))) * STEPS).alias("step")
    rows = scored.join(labels, "doc_id").groupBy(step).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).sort("step").collect()
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return float("-inf")
    best, cut, g, b = 1.0, float("-inf"), 0, 0
    for r, after in zip(rows, [*rows[1:], None]):
        g, b = g + r.good, b + r.bad
        if after and b / bad + 1 - g / good > best + 1e-12:
            best, cut = b / bad + 1 - g / good, (r.step + after.step + 1) / 2 / STEPS
    return cut


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 50, trusted_rows: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row.

    ``labels`` (doc_id, quality 0 or 1) names trusted documents (1) and known bad ones (0); null labels and ids are
    ignored, and of repeated ones the last value wins by maximum. Base rules: fewer than ``min_words`` words, or more
    than half of the words in repeated three-word windows. The rest is kept when its length-normalised log-likelihood
    ratio, trusted against raw, reaches the threshold that the labelled documents passing the base rules give. The ratio's
    trusted side is fitted on at most ``trusted_rows`` labelled ids; raw counts, scores and threshold cover all rows.

    A null text counts as empty (it fails), rows may repeat, an empty table gives an empty result. Other columns, whatever
    their names, are ignored. Texts of any length are counted whole.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("good"))
    ratio = fit_ratio(docs, labels.where("good = 1").select("doc_id"), trusted_rows, text=text, doc_id=doc_id)
    scored = written(measure(docs, ratio, text, doc_id), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    cut = best_threshold(scored.where("not base_failed"), labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(cut)))
