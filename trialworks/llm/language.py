"""Language identification in two steps: the family by linear scores, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialworks.storage import written

#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Hash buckets of byte bigrams and of byte trigrams.
BUCKETS = 4096
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed letter n-grams (bytes of the lower-cased text, words kept apart)."""
    b = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = (two[:-1] * np.uint32(2654435761) + b[2:] * np.uint32(40503)) >> np.uint32(15)
    x = np.concatenate([np.bincount(two % BUCKETS, minlength=BUCKETS), np.bincount(three % BUCKETS, minlength=BUCKETS)])
    return np.sqrt(x / max(1, 2 * len(two))).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge SVM, by dual coordinate descent. y is -1 or 1, or 0 for rows left out."""
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    q = np.einsum("ij,ij->i", x, x) + 0.5 / c
    order, rows = np.random.default_rng(seed), np.flatnonzero(y)
    for _ in range(epochs):
        for i in order.permutation(rows):
            g = y[i] * float(x[i] @ w) - 1 + 0.5 / c * a[i]
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w


class LanguageModel:
    """Scores of the families (one row each), and per family one separating row for each pair of its languages.

    With a single language every text with a letter is in it, with score 1. ``x`` has a last column of ones.
    """

    def __init__(self, x: np.ndarray, langs: list[str | None]):  # None for rows left out
        known = np.array([v is not None for v in langs])
        lab = np.array([v or "" for v in langs])
        fam = np.array([FAMILY_OF.get(v, v) or "" for v in langs])
        self.langs, self.families = sorted(set(lab[known])), sorted(set(fam[known]))
        rows = [linear_svm(x, np.where(fam == f, 1, -1) * known) for f in self.families] if len(self.families) > 1 else []
        self.members = {f: sorted(set(lab[known & (fam == f)])) for f in self.families}
        self.pairs: dict[str, list[tuple]] = {}
        for f, own in self.members.items():
            self.pairs[f] = []
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    self.pairs[f].append((a, b, len(rows)))
                    rows.append(linear_svm(x, (lab == a).astype(int) - (lab == b)))
        self.w = np.array(rows, np.float32).reshape(len(rows), 2 * BUCKETS + 1)
        self.cut = 0.0  # below it a text is in none of the languages

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        s = x @ self.w[:, :-1].T + self.w[:, -1]
        return [self._decide(r) for r in s]

    def _decide(self, s: np.ndarray) -> tuple[str, float]:
        family, margin = self.families[0], np.inf
        if len(self.families) > 1:
            top = np.sort(s[: len(self.families)])[::-1]
            family, margin = self.families[int(np.argmax(s[: len(self.families)]))], float(top[0] - top[1])
        votes = {v: [0, 0.0, np.inf] for v in self.members[family]}
        for a, b, k in self.pairs[family]:
            won, lead = (a, float(s[k])) if s[k] >= 0 else (b, -float(s[k]))
            votes[won][0] += 1
            votes[won][1] += lead
            votes[won][2] = min(votes[won][2], lead)
        lang = min(votes, key=lambda v: (-votes[v][0], -votes[v][1], v))
        margin = min(margin, votes[lang][2])
        return lang, 1.0 if margin == np.inf else float(1 / (1 + np.exp(-3 * margin)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample_rows: int = 2400, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel | None:
    """Learns from at most ``sample_rows`` labelled documents that are not held out, as many of each language.

    The sample is the documents of each language whose id hashes lowest; the cut of the hash is a number per language, so
    no text is shuffled. Only the sample's sparse features reach the driver. None where there is no labelled document.

    Every fifth of a language's sample is left out of the fit, whatever its size; those that are placed right set the cut,
    half as far above chance as the least sure of them. A sample with fewer than five of each language rejects nothing.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 12)
    keys = rows.select("lang", draw.alias("draw"))
    counts = keys.groupBy("lang").count()
    n = counts.count()
    if not n:
        return None
    each = max(1, sample_rows // n)
    small = F.broadcast if n <= 10_000 else (lambda df: df)  # a row per language
    # A hash threshold thins the hot languages before the rank: about twice the rows wanted remain.
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 100) / F.col("count"))
    near = keys.join(small(counts.select("lang", (share * 2**52).cast("long").alias("cut"))), "lang").where(F.col("draw") <= F.col("cut"))
    cuts = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(f"n <= {each}")
    cuts = written(cuts.groupBy("lang").agg(F.max("draw").alias("cut")), "cuts")
    own = rows.join(small(cuts), "lang").where(draw <= F.col("cut")).select("doc_id", "lang", "text")

    @F.pandas_udf("struct<at: binary, x: binary>")  # numbers as bytes, which take little room on the driver
    def sparse(texts):
        import pandas as pd

        x = [features(t) for t in texts]
        at = [np.flatnonzero(v) for v in x]
        return pd.DataFrame({"at": [a.astype(np.int16).tobytes() for a in at], "x": [v[a].tobytes() for v, a in zip(x, at)]})

    # Rows that repeat an id share its hash and could exceed the bound.
    got = own.select("doc_id", "lang", sparse("text").alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    x = np.ones((len(got), 2 * BUCKETS + 1), np.float32)
    x[:, :-1] = 0
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.f.at, np.int16)] = np.frombuffer(r.f.x, np.float32)
    langs = [r.lang for r in got]
    # Every fifth of a language is left out of the fit and sets the cut: half as far above chance as the least sure of the right ones.
    seen, out = Counter(), []
    for v in langs:
        seen[v] += 1
        out.append(seen[v] % 5 == 0)
    out = np.array(out)
    model = LanguageModel(x, [None if o else v for v, o in zip(langs, out)])
    right = [score for v, (lang, score) in zip([v for v, o in zip(langs, out) if o], model.predict(x[out, :-1])) if v == lang]
    model.cut = 0.5 + (min(right) - 0.5) / 2 if right else 0.0
    return model


def predict_language(text: Column, model: LanguageModel | None) -> Column:
    """struct(lang, score) of a whole text; ``und`` with score 0 for a null text or one without a letter.

    Texts of any length are read whole. The column is evaluated once even where a filter and a projection both use it.
    """

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts):
        import pandas as pd

        out = []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256]
            known = [t is not None and model is not None and bool(LETTER.search(t)) for t in part]
            x = [features(t) for t, k in zip(part, known) if k]
            found = iter(model.predict(np.array(x)) if x else [])
            out += [next(found) if k else ("und", 0.0) for k in known]
        return pd.DataFrame(out, columns=["lang", "score"])

    return predict.asNondeterministic()(text)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter, as :func:`predict_language` sees it; false for null."""

    @F.pandas_udf(T.BooleanType())
    def run(texts):
        return texts.map(lambda t: t is not None and bool(LETTER.search(t))).astype(bool)

    return run(text)


def identify_languages(docs: DataFrame, sample_rows: int = 2400, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone.

    Rows with a null id are predicted but never learned from; without any labelled row every prediction is ``und``.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    model = fit_languages(docs, sample_rows, text, lang, doc_id)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict_language(F.col(text), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
