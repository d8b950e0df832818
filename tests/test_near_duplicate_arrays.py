import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.functions import shingles as H
from trialworks.functions import text as X
from trialworks.operators import duplicates as D


def texts(draw, n):
    """Texts over few letters, of all lengths from none, some of them near copies."""
    out = ["", "a", "abcd", "abcde"]
    while len(out) < n:
        t = "".join(draw.choice(list("abc "), int(draw.integers(5, 400)))).strip()
        out += [t, t[: len(t) - int(draw.integers(0, 9))] + "b"]
    return out[:n]


def test_loose_texts_in_arrays(spark):
    import pyarrow as pa

    odd = [None, "", " ", "12", "  A1b  22,3 \t\n", "#9#", "É x İI K", "a\x0b\x1cb", "\U0001f600 7 7٠", "..x..", "\x00y"]
    draw = np.random.default_rng(2)
    odd += ["".join(draw.choice(list("aB1 #.é中\U0001f600\t\n-"), 40)) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", F.lower("t").alias("l"), X.norm_loose(F.col("t")).alias("n")).orderBy("i").collect()
    lower = pa.array(["x", *[r.l for r in rows]])[1:]  # a slice with an offset
    assert [t.decode() for t in H.loose(lower)] == [r.n or "" for r in rows]


def test_sketches_equal_plain_python():
    import zlib

    draw = np.random.default_rng(4)
    params = D.hash_parameters(8)
    for k, some in ((5, texts(draw, 60)), (5, ["é" * 9, "plain text", "zz"]), (9, texts(draw, 9))):
        m, size, bins = H.sketches([t.encode() for t in some], params, k, at_once=100)
        for i, t in enumerate(some):
            crc = [zlib.crc32(s.encode()) for s in D.shingle_set(t, k)]
            assert size[i] == len(crc)
            assert list(m[i]) == [min(((a * (c % D.PRIME) + b) % D.PRIME for c in crc), default=0) for a, b in params]
            width = 1 << max(3, (len(crc) // 8).bit_length())
            counts = np.bincount([c & (width - 1) for c in crc], minlength=width) if crc else np.zeros(width, int)
            assert bins[i] == int(np.maximum(counts - 255, 0).sum()).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()
        assert [D.similarities([p], [q], k)[0] for p, q in itertools.product(some[:9], repeat=2)] == [len(a & b) / max(1, len(a | b)) for a, b in itertools.product([D.shingle_set(t, k) for t in some[:9]], repeat=2)]


@pytest.mark.parametrize("block", [4096, 7])
def test_rows_of_a_bucket_meet_as_arrays(spark, block):
    draw = np.random.default_rng(6)
    some = texts(draw, 80)[4:]
    _, size, bins = H.sketches([t.encode() for t in some], D.hash_parameters(1), 5)
    rows = [(i % 3, r, int(size[r]), bins[r], r % 5, bool(r % 4)) for i in range(2) for r in range(len(some)) if r % 3 != i]
    count = {k: sum(r[0] == k for r in rows) for k in (0, 1, 2)}
    hits = spark.createDataFrame([(k, count[k], *r) for k, *r in rows], "key long, c long, row long, size long, bins binary, label long, meet boolean")
    want = set()
    for (k, r, m, x, p, s), (l, q, n, y, o, t) in itertools.combinations(rows, 2):
        most = D.most_shared(x, y)
        if k == l and r != q and p != o and (s or t) and min(m, n) + 1e-6 >= max(m, n) * 0.8 and most + 1e-6 >= (m + n - most) * 0.8:
            want.add((min(r, q), max(r, q)))
    got = [(r.a, r.b) for r in D._meeting(hits, 0.8, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_pairs_of_a_bucket_are_no_rows(spark):
    """Thousands of texts in one bucket: no join makes their pairs, only arrays do."""
    docs = spark.createDataFrame([(i, f"aaaaaaaa {chr(97 + i % 26) * (i + 9)}") for i in range(40)], "doc_id long, text string")
    plan = D._meeting(D._buckets(D._sketched(docs, 1, 1, 5, "text", "doc_id")[1]).select("key", "c", "row", "size", F.lit(b"\0" * 16).alias("bins"), F.col("row").alias("label"), F.lit(True).alias("meet")), 0.8)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 and "MapInArrow" in text  # the join is that with the buckets' counts
