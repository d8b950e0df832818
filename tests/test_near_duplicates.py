import itertools
import zlib

import numpy as np

from trialworks.operators import duplicates as D

SCHEMA = "doc_id long, text string"


def sim(a, b):
    s, t = D.shingle_set(a), D.shingle_set(b)
    return len(s & t) / len(s | t)


def words(draw, n):
    return ["".join(draw.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(n)]


def least(text):
    (a, b), = D.hash_parameters(1)
    return min((a * (zlib.crc32(s.encode()) % D.PRIME) + b) % D.PRIME for s in D.shingle_set(text))


def brute(rows):
    label = {i: i for i, _ in rows}
    for (i, s), (j, t) in itertools.combinations(rows, 2):
        if sim(s, t) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {x: new if c == old else c for x, c in label.items()}
    return label


def clusters(docs, **options):
    return {r.id: r.component for r in D.near_duplicate_clusters(docs, **options).collect()}


def test_a_hub_that_is_close_to_neither_of_two_linked_texts(spark):
    draw = np.random.default_rng(3)
    base = words(draw, 60)
    x, y = " ".join(base), " ".join(base[:-1] + ["other"])
    assert least(x) == least(y) and sim(x, y) > 0.8
    halves = (" ".join(half + words(draw, 30)) for half in itertools.cycle([base[:30], base[30:]]))
    hub = next(h for h in halves if least(h) == least(x))
    assert sim(hub, x) < 0.6 and sim(hub, y) < 0.6
    docs = spark.createDataFrame([(1, hub), (2, x), (3, y)], SCHEMA)
    assert [(r.a, r.b) for r in D.near_duplicate_pairs(docs, n=1, bands=1).collect()] == [(2, 3)]
    assert clusters(docs, n=1, bands=1) == {1: 1, 2: 2, 3: 2}


def test_pairs_and_clusters_against_brute_force(spark):
    draw = np.random.default_rng(8)
    common, rows = words(draw, 30), []
    for group in range(8):  # texts of different groups share words and so buckets
        base = common + words(draw, 22)
        for _ in range(5):
            t = list(base)
            for at in draw.integers(0, len(t), draw.integers(0, 4)):
                t[at] = words(draw, 1)[0]
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(i, j) for (i, s), (j, t) in itertools.combinations(rows, 2) if s != t and sim(s, t) >= 0.8}
    least_id = {}
    for i, t in rows:
        least_id.setdefault(t, i)
    want = {(least_id[rows[i][1]], least_id[rows[j][1]]) for i, j in want}
    assert {(r.a, r.b) for r in D.near_duplicate_pairs(docs).collect()} == {(min(p), max(p)) for p in want}
    assert clusters(docs) == brute(rows)


def test_bins_bound_what_two_texts_share(spark):
    draw = np.random.default_rng(8)
    base = words(draw, 300)
    texts = ["", "ab", "a b c", " ".join(base), " ".join(base[:290] + words(draw, 10)), " ".join(words(draw, 300)), " ".join(words(draw, 3000)), " ".join(base[:20])]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).select("doc_id", D.sketch(D.F.col("text")).alias("s")).select("doc_id", "s.*").orderBy("doc_id").collect()
    sets = [D.shingle_set(t) for t in texts]
    assert [r["size"] for r in rows] == [len(s) for s in sets]
    for a, b in itertools.product(range(len(texts)), repeat=2):
        most = D.most_shared(rows[a].bins, rows[b].bins)
        assert len(sets[a] & sets[b]) <= most <= min(len(sets[a]), len(sets[b]))
    assert D.most_shared(rows[3].bins, rows[5].bins) < 0.85 * len(sets[3])  # texts with nothing in common are told apart
    full = np.array([5], "<u8").tobytes() + bytes([255] * 8)  # bins that had no room for 5 more
    assert D.most_shared(full, np.array([3], "<u8").tobytes() + bytes([255] * 16)) == 8 * 255 + 3


def test_similarity_holds_the_sets_of_one_pair():
    import tracemalloc

    draw = np.random.default_rng(9)
    text = [" ".join(words(draw, 200)) for _ in range(30)]
    pairs = text * 10, (text[1:] + text[:1]) * 10
    tracemalloc.start()
    found = D.similarities(*pairs, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [sim(a, b) for a, b in zip(*pairs)]
    assert peak < 2_000_000  # the sets of all 300 pairs are some 50 MB
