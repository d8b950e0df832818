import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from trialworks.llm import parsing

SCHEMA = "doc_id long, text string, lang string, block long, part long, t string, words string"


def brute(docs, length=35):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["x", "y", "é", "z z", f"w{rnd.randrange(3000)}"])
    passage = [[word() for _ in range(rnd.choice([20, 34, 35, 36, 60, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(5)):
            w += rnd.choice(passage) if rnd.random() < 0.5 else [word() for _ in range(rnd.randrange(80))]
        docs.append((i, "".join(x + rnd.choice([" ", "\n", "\t", "  ", "\x0b"]) for x in w)))
    docs += [(100, "a " * 36), (101, "b " * 35), (102, "c d " * 60), (103, ""), (104, None), (None, docs[3][1]), (None, docs[3][1]), (105, " \n"), (106, docs[5][1]), (106, docs[6][1])]
    return docs


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_bytes": 2000, "bucket_bytes": 3000, "parts": 3}), (3, {"block_bytes": 500, "bucket_bytes": 1000, "hot": 3}), (4, {"length": 16, "block_bytes": 4000, "hot": 5})])
def test_equals_brute_force(spark, seed, options):
    docs = corpus(seed)
    rows = [(i, t, "en", 1, 2, "x", "y") for i, t in docs]
    assert got(parsing.remove_passages(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)) == brute(docs, options.get("length", 35))


def test_phrase_that_a_third_of_all_documents_hold_in_other_surroundings(spark):
    rnd = random.Random(9)
    phrase = [f"p{i}" for i in range(28)]  # an anchor in each document, but no repeated window
    docs = [(i, " ".join([f"{i}a{j}" for j in range(30)] + (phrase if i % 3 == 0 else []) + [f"{rnd.randrange(9)}b{j}" for j in range(9)])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(parsing.remove_passages(df, block_bytes=5000, bucket_bytes=20000, hot=10)) == brute(docs)


def test_empty_table(spark):
    df = parsing.remove_passages(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == [] and df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(parsing, "run_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9, 7, 2, 3, 4])
    assert parsing.repeated_windows(ids, [(0, 4, False), (4, 8, False), (8, 12, False)], 3) == [[(0, 1)], [(0, 0)], [(1, 1)]]


def test_factors_end_and_windows_across_their_ends_are_looked_up():
    a, b = list(range(40)), list(range(100, 140))
    ids = np.array(a + b + a[10:] + b[:20] + b[5:25] + a[30:] + b[:5])
    spots = [(0, 80, False), (80, 130, False), (130, len(ids), False)]
    w = [tuple(ids[i : i + 12]) if any(s <= i and i + 12 <= e for s, e, _ in spots) else None for i in range(len(ids))]
    n = Counter(x for x in w if x)
    want = [[i - s for i in range(s, e - 11) if n[w[i]] > 1] for s, e, _ in spots]
    found = parsing.repeated_windows(ids, spots, 12)
    assert [[i for x, y in runs for i in range(x, y + 1)] for runs in found] == want
