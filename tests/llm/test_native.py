import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialworks.llm.exact import exact_groups, keep_rows
from trialworks.llm.sharding import hilbert_index, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bytes string, hash string, slot long, cell long"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, 1, 1) for r in rows], SCHEMA)


def odd(n=60):
    rng = np.random.default_rng(5)
    base = [(i, rng.choice(["a b", "ab", "a\nb ", "c", "", " ", "é é", "x" * 3000]), "en", ["s1", "s1", "s2", None][i % 4], 3) for i in range(n)]
    return base + [(7, base[7][1], "en", "s1", 3), (7, base[7][1], "en", "s1", 3), (8, None, None, None, None), (None, "ab", "de", "s2", 1), (-3, "ab\t", "en", "s2", 1)]


def squeeze(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_exact_groups_against_brute_force(spark):
    rows = odd()
    got = exact_groups(table(spark, rows)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    want = Counter((r[0], best[squeeze(r[1])][0], len(groups[squeeze(r[1])]), hashlib.sha256(squeeze(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert sorted(g.text_sha256 for g in got if g.kept) == sorted(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert exact_groups(table(spark, [])).collect() == []


def test_keep_rows_keeps_columns_and_one_of_repeats(spark):
    docs = table(spark, odd())
    out = keep_rows(docs, spark.createDataFrame([(7,), (None,)], "doc_id long"))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["7", "None"]


def test_hilbert_curve_steps_by_one():
    for n, bits in ((2, 3), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        index = hilbert_index(list(points.T), bits)
        assert sorted(index) == list(range(len(points)))
        path = points[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_shards(spark, rows, shards=8, bits=4):
    """The whole result from plain lists: quantise, order by curve, text and hashed id, cut."""
    n = len(rows)
    ids = spark.createDataFrame([(i, r[0], r[1] or "") for i, r in enumerate(rows)], "i int, id long, t string").select("i", F.xxhash64(F.col("id").cast("string")).alias("h"), F.xxhash64("t").alias("x"))
    hashes = {r.i: (r.h, r.x) for r in ids.collect()}

    def codes(values):
        ordered, cuts = sorted(v for v in values if v is not None), []
        runs = (1 << bits) - 1
        for i, v in enumerate(ordered):
            if i == 0 or v != ordered[i - 1]:
                run = i * runs // len(ordered)
                if run > 0 and run not in [c[0] for c in cuts]:
                    cuts.append((run, v))
        return [0 if v is None else 1 + max((run for run, c in cuts if v >= c), default=0) for v in values]

    size = [len((r[1] or "").encode()) + 1 for r in rows]
    dims = [codes([None if r[2] is None else r[2].encode() for r in rows]), codes([None if r[3] is None else r[3].encode() for r in rows]), codes(size)]
    cell = hilbert_index([np.array(d) for d in dims], bits)
    low = {}
    for r, c in zip(rows, cell):
        low[r[1] or ""] = min(low.get(r[1] or "", 1 << 60), int(c))
    line = sorted(range(n), key=lambda i: (low[rows[i][1] or ""], zlib.crc32((rows[i][1] or "").encode()), hashes[i][1], size[i], hashes[i][0]))
    return Counter((rows[i][0], at * shards // n, at - -(-(at * shards // n) * n // shards)) for at, i in enumerate(line))


@pytest.mark.parametrize("per", [5, 10**6])
def test_shards_against_brute_force(spark, per):
    rows = odd(203)
    got = shard(table(spark, rows), rows_per_bucket=per).collect()
    assert Counter((g.doc_id, g.shard, g.slot) for g in got) == brute_shards(spark, rows)
    n = Counter(g.shard for g in got)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(n[s]))
    line = sorted(got, key=lambda g: (g.shard, g.slot))
    assert [g.cell for g in line] == sorted(g.cell for g in line)
    runs = [k for k, _ in itertools.groupby(g.text_crc32 for g in line)]
    assert len(runs) == len(set(runs))  # equal texts lie together, across one cut at most
    assert all(g.law == "rows" and g.grown_shard is None for g in got)


def test_shards_of_empty_and_tiny_tables_and_long_texts(spark):
    rows = [(i, "x" * (1 + 100_000 * i), "en", "s", 1) for i in range(5)]
    assert shard(table(spark, [])).collect() == []
    assert len(shard(table(spark, rows[:3])).collect()) == 3
    assert sorted(g["size"] for g in shard(table(spark, rows)).collect()) == [2 + 100_000 * i for i in range(5)]


def test_ranges_of_shards_prune(spark):
    draw = np.random.default_rng(6)
    rows = [(i, f"{i} " + "w" * int(2 ** draw.uniform(0, 12)), str(draw.choice(["de", "en", "es", "fr"])), f"s{draw.integers(20):02}", 1) for i in range(4000)]
    got = shard(table(spark, rows)).collect()
    ranges = {}
    for g in got:
        for c in ("lang", "source", "size"):
            lo, hi = ranges.get((g.shard, c), (g[c], g[c]))
            ranges[g.shard, c] = min(lo, g[c]), max(hi, g[c])
    for c in ("lang", "source", "size"):  # shards that a filter for one value need not read, on average over rows
        skipped = np.mean([np.mean([not ranges[s, c][0] <= g[c] <= ranges[s, c][1] for s in range(8)]) for g in got[::40]])
        assert skipped > 0.3, (c, skipped)
