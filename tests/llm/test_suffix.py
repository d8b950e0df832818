import hashlib

import numpy as np
import pytest

from trialworks.llm.suffix import equal_groups, remove_repeats, seed_hashes, sliding_min

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, t string, bucket long"


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        runs = "".join("x" if g else " " for g in gone).split()
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), len(runs), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["the", "é", "on", "an", "漢字", "tion", "x"]
    passages = [" ".join(rng.choice(words, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 8)):
            k = rng.integers(4)
            p = passages[rng.integers(6)]
            parts.append(p if k == 0 else p[rng.integers(20) : 60 + rng.integers(40)] if k == 1 else " ".join(rng.choice(words, rng.integers(1, 60))))
        rows.append((int(rng.integers(10**6)), " ".join(parts)))
    long = "".join(rng.choice(list("abcdefgh "), 30_000))
    return rows + [(rows[0][0], rows[0][1]), (rows[0][0], rows[3][1]), (7, None), (8, ""), (None, rows[2][1]), (-4, passages[0]), (9, "a" * 300), (10, "a" * 49), (11, "a" * 50), (12, "b" + "a" * 400), (13, long), (14, long[100:20_000] + "z"), (-9, "ab" * 100), (15, "ba" * 60), (9_999_999, passages[1])]


@pytest.mark.parametrize("seed,block,bucket", [(1, 4_000_000, 24_000_000), (2, 6_000, 9_000)])
def test_against_brute_force(spark, seed, block, bucket):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "en", "s", 1, 1, "t", 1) for r in rows], SCHEMA).repartition(4)
    got = remove_repeats(df, block_bytes=block, bucket_bytes=bucket).collect()
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute(rows)
    assert all(hashlib.sha256(g.kept_text).hexdigest() == g.kept_sha256 for g in got)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_groups_sorts_suffixes():
    rng = np.random.default_rng(3)
    for alphabet in (b"a", b"ab", b"abcdefgh"):
        text = bytes(rng.choice(list(alphabet), 3000)) + b"ab" * 100
        buf = np.frombuffer(text + b"\0" * 8, np.uint8)
        places = rng.permutation(len(text) - 50)
        group = equal_groups(buf, places, 50)
        strings = [text[p : p + 50] for p in places]
        rank = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert group.tolist() == [rank[s] for s in strings]


def test_sliding_min_and_hashes():
    h = np.random.default_rng(4).integers(0, 2**63, 200).astype(np.uint64)
    for w in (1, 2, 7, 27, 64):
        assert sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(200 - w + 1)]
    b = np.frombuffer(b"xyz" + b"abcdefghijklmnopqrstuvwxyz" * 2, np.uint8)
    s = seed_hashes(b)
    assert s[3] == s[29] and len(set(s[:26].tolist())) == 26
