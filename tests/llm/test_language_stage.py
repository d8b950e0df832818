import numpy as np
import zlib

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]


@pytest.mark.parametrize("lang", [None, "en"])
def test_texts_stay_where_no_model_can_be_fitted(spark, lang):
    """Without any label, and with labels in the held-out fold only."""
    rows = [(i, f"some words of text {i}", lang, "s", 1) for i in FOLD[:20]] + [(FOLD[20], "12 34", lang, "s", 1), (FOLD[21], None, lang, "s", 1)]
    got = P.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(tuple(r) for r in got) == rows[:20]


def test_texts_between_the_languages_go_and_clean_ones_stay(spark):
    draw = np.random.default_rng(5)
    parts = {"en": ["the", "and", "with", "thing", "ing", "wor"], "de": ["der", "und", "schau", "keit", "ein", "zwo"]}
    word = lambda lang: "".join(draw.choice(parts[lang], 3))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang, "s", 1) for i in range(300) for lang in ["en", "de"][i % 2 : i % 2 + 1]]
    mixed = [(1000 + i, " ".join(word(["en", "de"][j % 2]) for j in range(400)), None, "s", 1) for i in range(20)]
    kept = {r.doc_id for r in P.language_id(spark, spark.createDataFrame(rows + mixed, SCHEMA), "").collect()}
    assert kept >= {r[0] for r in rows} and len(kept & {r[0] for r in mixed}) < 10
    assert P.language_id(spark, spark.createDataFrame(rows[::2], SCHEMA), "").count() == 150  # a single language
