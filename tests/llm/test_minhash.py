import re

import numpy as np
import pytest

from trialworks.llm.minhash import WordHashes, near_duplicates, shingle_set, signature

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, n long, key long, row long"


def shingles(t, k):
    w = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    return {w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else ({w} if w else set())


def brute(rows, k, percent):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    sets = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: find(i) for i in ids}


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        kind = rng.integers(4)
        if kind == 0 or not base:
            words = list(rng.choice(vocab, rng.integers(1, 120)))
            base.append(words)
        else:  # a chain of small edits of an earlier text
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 1 + len(words) // 20)):
                words[rng.integers(len(words))] = rng.choice(vocab)
            base.append(words)
        t = " ".join(words)
        rows.append((int(rng.permutation(10**6)[0]) if i % 7 == 0 else 1000 + i, t.upper() if i % 9 == 0 else t))
    rows += [(5, None), (6, ""), (7, " \n"), (8, "w1"), (9, "W1 "), (10, "w1 w2"), (11, "w2 w1"), (None, rows[0][1]), (12, rows[0][1]), (12, rows[1][1]), (12, rows[1][1]), (13, "w7 " * 20_000), (14, "w7 " * 19_000)]
    return [(*r, "en", "s", 1, 1, 1, 1, 1) for r in rows]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_components_against_brute_force(spark, seed, k):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k).collect()
    assert len(got) == len(rows)
    want = brute(rows, k, 80)
    assert {g.doc_id: g.component_id for g in got if g.doc_id is not None} == want
    assert all(g.component_id is None and g.kept for g in got if g.doc_id is None)
    sizes = sorted((str(r[0]), len(shingles(r[1], k))) for r in rows)
    assert sorted((str(g.doc_id), g.n_shingles) for g in got) == sizes
    assert all(g.kept == (g.doc_id == g.component_id) for g in got if g.doc_id is not None)


def test_hub_that_splits_into_groups_keeps_all_links(spark):
    # two groups share enough to meet in buckets, with the least id in neither
    rng = np.random.default_rng(8)
    core = [f"c{i}" for i in range(60)]
    a, b = [f"a{i}" for i in range(22)], [f"b{i}" for i in range(22)]
    rows = [(0, " ".join(core))]
    for i in range(1, 60):
        own = list((a, b)[i % 2])
        own[rng.integers(len(own))] = f"x{i}"
        rows.append((i, " ".join(core + own)))
    rows = [(*r, "en", "s", 1, 1, 1, 1, 1) for r in rows]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4).collect()
    assert {g.doc_id: g.component_id for g in got} == brute(rows, 4, 80)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_estimates_similarity():
    words, rng = WordHashes(), np.random.default_rng(9)
    for share in (0.5, 0.8, 0.95):
        x = [f"v{i}" for i in rng.permutation(4000)]
        n = int(2000 * 2 * share / (1 + share))
        s, t = shingle_set(" ".join(x[:2000]), 1, words), shingle_set(" ".join(x[2000 - n : 4000 - n]), 1, words)
        assert abs(np.mean(signature(s, 252) == signature(t, 252)) - share) < 0.12
