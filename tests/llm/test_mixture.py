from collections import Counter

import numpy as np

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def skewed(n=4800):
    """Two thirds of the documents are of source s0, and ids run against any mixed order."""
    draw = np.random.default_rng(4)
    return [(i, " ".join(f"w{x}" for x in draw.integers(0, 900, 150)), "en", ["s0", "s0", "s1", "s0", "s0", "s2"][i % 6], 1) for i in range(n)]


def windows(spark, rows, weights=None):
    """Per window of 16 sequences, the tokens of each source; and each source's documents as they come."""
    docs = spark.createDataFrame(rows, SCHEMA)
    given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
    out = P.packing(spark, docs, "", weights=given, length=1024, lane_bytes=1_000_000).collect()
    source = {r[0]: r[3] for r in rows}
    shares, order = {}, {}
    for p in sorted(out, key=lambda p: (p.sequence_id, p.offset)):
        shares.setdefault(p.sequence_id // 16, Counter())[source[p.doc_id]] += p.length
        order.setdefault(source[p.doc_id], []).append(p.doc_id)
    assert Counter(p.doc_id for p in out if p.start == 0) == Counter(r[0] for r in rows)
    return shares, order


def test_packed_windows_follow_the_target_weights(spark):
    rows = skewed()
    even, order = windows(spark, rows, {"s0": 1.0, "s1": 1.0, "s2": 1.0})
    hot, _ = windows(spark, rows, {"s0": 8.0, "s1": 1.0, "s2": 1.0})
    own, _ = windows(spark, rows)
    for got, share in ((even, 1 / 3), (hot, 0.8), (own, 2 / (2 + 1 + 1))):  # bytes 4:1:1 to the power 0.5
        for part in range(4):  # the first two fifths of the line, where no source has run dry
            run = sum((got[w] for w in range(len(got) * part // 10, len(got) * (part + 1) // 10)), Counter())
            assert abs(run["s0"] / run.total() - share) < 0.05, (part, share, run)
    assert all(list(dict.fromkeys(ids)) != sorted(set(ids)) for ids in order.values())  # the mixed order, not that of ids


def test_packing_takes_order_and_weights_from_the_files_it_reads(spark, tmp_path):
    rows = [(r[0], r[1], "en", ["s0", "s0", "s1"][i % 3] if i < 900 else "s0", 1) for i, r in enumerate(skewed(1200))][::-1]  # s1 ends before s0 begins to be alone, read backwards
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(rows[::-1], SCHEMA).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/b")
    for path, want in (("a", rows), ("b", rows[::-1])):
        out = sorted(P.packing(spark, spark.read.parquet(f"{tmp_path}/{path}"), "", length=1024, lane_bytes=100_000).collect(), key=lambda p: (p.sequence_id, p.offset))
        first = list(dict.fromkeys(p.doc_id for p in out))
        for s in ("s0", "s1"):
            mine = {r[0] for r in want if r[3] == s}
            assert [i for i in first if i in mine] == [r[0] for r in want if r[3] == s]
    rows, _, place = P.file_order(spark.read.parquet(f"{tmp_path}/b"))
    w = P.weights_of_order(rows, place)
    assert w["s0"] == 1.0 and abs(w["s1"] - 0.5) < 0.05  # a third of what is there until it ends
