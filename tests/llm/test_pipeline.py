import re
from collections import Counter

import corpus_pipeline as P
from tests.llm.test_minhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    import numpy as np

    rng = np.random.default_rng(12)
    words = {"en": ["the", "and", "with", "thing", "ing"], "de": ["der", "und", "schau", "keit", "ein"]}
    rows = []
    for i in range(90):
        lang = ["en", "de"][i % 2]
        t = [" ".join("".join(rng.choice(words[lang], rng.integers(1, 5))) for _ in range(rng.integers(20, 160)))]
        rows.append((i, t[0], None if i % 10 == 3 else lang, f"s{i % 3}", 1))
        if i % 6 == 0:
            rows.append((1000 + i, t[0].replace(" ", "  "), lang, "s0", 1))
        if i % 6 == 1:
            w = t[0].split()
            w[len(w) // 2] = "changed"
            rows.append((2000 + i, " ".join(w), lang, "s1", 1))
    return rows + [(5000, None, "en", "s0", 0), (5001, "123 456", "en", "s0", 0), (5002, "", None, None, None), (0, rows[0][1], "en", "s0", 1), (5003, rows[4][1], "en", None, 1)]


def expected(rows):
    left = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    best = {}
    for r in left:
        best.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r[1]), []).append(r)
    left = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in best.values()]
    comp = brute(left, 5, 80)
    return [r for r in left if comp[r[0]] == r[0]]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r[0], r[1]) for r in expected(rows))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    got = docs.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.lang in ("en", "de") for r in got)
    out = P.run(spark, str(tmp_path)).toPandas()
    from tests.llm.test_tokens_packing import WORDS, word_ids

    sizes = {r[0]: len(word_ids(WORDS).ids(r[1], 2)) // 4 for r in expected(rows)}
    assert out.groupby("doc_id")["length"].sum().to_dict() == sizes


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
