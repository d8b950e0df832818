import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.functions import text as X
from trialworks.operators import lexicon as L


@pytest.mark.parametrize("slice_words", [400_000, 5])
def test_features_whatever_the_slices(spark, slice_words):
    """Against plain Python, with ids of several rows and none, words without some ratings, and a lexicon of several slices."""
    draw = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["it's", "the"]
    columns = [*L.DIMENSIONS, *[f"{d}_{s}" for p in L.SEGMENTS.values() for s in p for d in ("valence", "arousal")]]
    rate = {w: {c: None if c == "concreteness" and i % 3 == 0 else float(np.round(draw.uniform(1, 9), 1)) for c in columns} for i, w in enumerate(words[:15])}
    lexicon = spark.createDataFrame([(w, *r.values()) for w, r in rate.items()], "word string, " + ", ".join(f"{c} double" for c in columns))
    texts = [(i, " ".join(draw.choice(words, int(draw.integers(0, 25)))).title()) for i in range(30)]
    texts += [(31, None), (32, "the the"), (33, "wa wa wa"), (34, "zz"), (7, "wb wb wc"), (None, "wd"), (None, "we wf wf zz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in L.lexicon_features(docs, lexicon, slice_words=slice_words).collect()}
    import re

    of: dict = {}
    for i, t in texts:
        all_ = re.findall(X.TOKEN, (t or "").lower())
        of.setdefault(i, []).append([w for w in all_ if w not in X.STOPWORDS] or all_)
    assert set(got) == set(of)
    of_lexicon = lambda c: [r[c] for r in rate.values() if r[c] is not None]
    z = lambda c, x: (x - np.mean(of_lexicon(c))) / np.std(of_lexicon(c))
    for i, rows in of.items():
        x = {c: [rate[w][c] for ws in rows for w in ws if w in rate and rate[w][c] is not None] for c in columns}
        v, a, c = x["valence"], x["arousal"], x["concreteness"]
        n, g = max(1, *map(len, rows)), got[i]
        firsts, lasts = [[rate[ws[k]][d] for ws in rows if ws and ws[k] in rate] for k, d in ((0, "arousal"), (-1, "valence"))]
        want = {"vad_coverage": len(v) / n, "conc_coverage": len(c) / n}
        if v:
            want |= {"valence_mean_z": z("valence", np.mean(v)), "valence_sd": np.std(v), "valence_max_z": z("valence", max(v)), "arousal_min_z": z("arousal", min(a)), "arousal_range": max(a) - min(a)}
            want |= {"valence_skew": np.mean(v) - (min(v) + max(v)) / 2, "dominance_sd": np.std(x["dominance"]), "valence_pos_frac": np.mean(np.array(v) > 6), "valence_neg_frac": np.mean(np.array(v) < 4)}
            want |= {"extremity_mean": np.mean(np.abs(np.array(v) - 5)), "extremity_max": np.max(np.abs(np.array(v) - 5)), "arousal_top3_z": z("arousal", np.mean(sorted(a)[-3:])), "valence_age_gap": np.mean(x["valence_y"]) - np.mean(x["valence_o"])}
        if c:
            want |= {"concrete_mean_z": z("concreteness", np.mean(c)), "concrete_sd": np.std(c), "concrete_frac_high": np.mean(np.array(c) > 4), "concrete_frac_low": np.mean(np.array(c) < 2)}
        want |= {"first_word_arousal_z": z("arousal", max(firsts)) if firsts else 0.0, "last_word_valence_z": z("valence", max(lasts)) if lasts else 0.0}
        assert {k: g[k] for k in want} == pytest.approx(want, abs=1e-9)
        assert all(y == 0 for k, y in g.items() if k != "doc_id") or v
        if len(set(v)) == 1:
            assert g["valence_sd"] == 0


def test_slices_of_words_agree(spark):
    """The two sides of the lookup put a word into the same slice."""
    words = [f"word{i}" for i in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert [r.s for r in df.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(7)).cast("int").alias("s")).collect()] == [zlib.crc32(w.encode()) % 7 for w in words]
    rows = L.word_counts(spark.createDataFrame([(1, "b b c the")], "doc_id long, text string"), 1, 1, "text", "doc_id").collect()
    assert [(r.looked_up, r.first, r.last, r.words, r.n) for r in rows] == [(3, "b", "c", ["b", "c"], [2, 1])]
