import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from trialworks.llm.packing import pack, serve_window, tail_lengths
from trialworks.llm.tokens import UnitCounts, count_tokens, word_ids

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", " \n ", "a", " a", "a  b   c ", "a\n\nb \n c", "\t\r\na b", "▁x ▁ y", "<s> a </s><unk>", "<|endoftext|> a<|startoftext|>b",
       "é́ 漢字 🙂🙂", "x" * 5000, "don't STOP 1234 #*$", "\x00\x01", "a▁▁b", "İstanbul ΣΑΣ"]


def test_unit_counts_equal_the_library():
    c = UnitCounts(PIECES)
    assert c.exact and len(c.proved) > 10_000
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(list("ab \n▁é.,T"), 40)) for _ in range(2000)]
    assert [c.count(t) for t in texts] == [len(x) for x in c.encode(texts)]


def test_word_ids_equal_the_library():
    w = word_ids(WORDS)
    rng = np.random.default_rng(1)
    for t in ODD + ["".join(rng.choice(list("aB \n\té.,'s1<|"), 40)) for _ in range(500)]:
        assert np.frombuffer(w.ids(t, 2), "<u4").tolist() == [*w.encode(t, add_special_tokens=False).ids, 2]
    texts = ODD + ["".join(rng.choice(list("aBéß \n\t.,'s!<|"), 60)) for _ in range(1500)] + ["Word,' don't,'s a|>b x<|endoftext|>, Straße!! ÉTÉ."]
    w.clear()
    for part in (texts, [t for t in texts if "<|" not in t], texts[:3] + [None]):
        for size in (10**6, 200):
            got = [np.frombuffer(x.as_py(), "<u4").tolist() for run in w.sliced(pa.array(part, pa.string()), size) for x in w.arrays(run, 2)[1]]
            assert got == [[*w.encode(t or "", add_special_tokens=False).ids, 2] for t in part]


def test_word_ids_start_afresh(monkeypatch):
    w, texts = word_ids(WORDS), [f"word{i} Other{i}, é{i}" for i in range(300)]
    monkeypatch.setattr("trialworks.llm.tokens.STRETCHES", 50)
    for at in range(0, 300, 30):
        n, ids = w.arrays(pa.array(texts[at : at + 30]), 2)
        assert [np.frombuffer(x.as_py(), "<u4").tolist() for x in ids] == [[*w.encode(t, add_special_tokens=False).ids, 2] for t in texts[at : at + 30]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, lane long"


def rows(n):
    rng = np.random.default_rng(2)
    out = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x1"], int(rng.integers(0, 900)))), "en", ["a", "a", "b", None][i % 4], 1, 7, 7) for i in range(n)]
    return out + [(3, out[3][1], None, "a", None, None, None), (None, "null id", None, "b", None, None, None), (-5, None, "en", "a", 0, 0, 0), (99_999, "word " * 30_000, "en", "b", 0, 0, 0)]


def test_counts_with_nulls_repeats_and_clashing_columns(spark):
    data = rows(20)
    got = count_tokens(spark.createDataFrame(data, SCHEMA), PIECES).collect()
    enc = UnitCounts(PIECES).encode
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(enc(r[1] or ""))) for r in data)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert count_tokens(spark.createDataFrame([], SCHEMA), PIECES).collect() == []


@pytest.mark.parametrize("lane_bytes", [20_000, 10**9])
def test_pack_round_trip(spark, lane_bytes):
    data = rows(150)
    got = pack(spark.createDataFrame(data, SCHEMA), WORDS, lane_bytes=lane_bytes).toPandas()
    get = word_ids(WORDS).ids
    ids = [get(r[1], 2) for r in data]
    assert got["length"].sum() == sum(len(x) // 4 for x in ids)
    want = {}
    for r, x in zip(data, ids):
        want.setdefault(r[0], []).append(x)
    for doc, g in got.groupby("doc_id", dropna=False):
        key = None if doc is None or doc != doc else int(doc)
        assert g["length"].sum() == sum(len(x) // 4 for x in want[key])
        if len(want[key]) == 1:
            x, at = want[key][0], 0
            for p in g.sort_values("start").itertuples():
                assert p.start == at and p.doc_tokens == len(x) // 4 and p.ids_crc32 == zlib.crc32(x[4 * at : 4 * (at + p.length)])
                at += p.length
    sizes = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all()
        sizes.append(g["length"].sum())
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)
    assert sorted(got["sequence_id"].unique()) == list(range(len(sizes)))


def test_windows_follow_the_shares():
    share, waiting = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10_000, "b": 10_000, "c": 700}
    deficits = dict.fromkeys(share, 0.0)
    for w in range(4):
        got = dict.fromkeys(share, 0)
        for s, n in serve_window(1000, deficits, share, waiting):
            got[s] += n
        assert sum(got.values()) == 1000
        if w < 3:
            assert got == {"a": 500, "b": 300, "c": 200}
    assert got["c"] == 100 and deficits["c"] == pytest.approx(100)
    assert tail_lengths(1234) == [1024, 128, 64, 16, 2] and tail_lengths(0) == []


def test_empty_table_packs_to_nothing(spark):
    assert pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []
