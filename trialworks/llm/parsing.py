"""Removal of word passages that occur elsewhere too, by relative Lempel-Ziv parsing against indexed reference blocks.

A reference block is what all documents hold around a set of anchors. Anchors are minimisers: of the hashes of the SEED-word
strings inside a window, the least marks a place, and equal windows mark the same place. So a window can only be repeated in
the reference block of its anchor, and each document is parsed against every block that can hold a match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Words of an anchor's hashed string.
SEED = 12
#: Bits of a place inside an array of words; the others rank the hash.
PLACE = 30
REMEMBERED = 400_000
UNIQUE, SHARED, HOT = 0, 1, 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(29))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` entries, by doubling."""
    out, done, width, at = None, 0, 1, h
    while True:
        if n & width:
            out = at if out is None else mixed(out[: len(h) - done - width + 1] * U(0x9E3779B97F4A7C15) + at[done : len(h) - width + 1])
            done += width
        if done == n:
            return out
        at = mixed(at[:-width] * U(0xD6E8FEB86659FD93) + at[width:])
        width *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    k, out = 1, h
    while 2 * k <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - k : len(h) - k + 1]) if k < w else out


def anchors(words: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that mark the same place: document, first and last start in it, hash of the marked string.

    ``words`` holds the word hashes of all documents in a row. Of equal least hashes in a window the first one marks, so
    two copies inside one window are two places.
    """
    none = np.empty(0, np.int64)
    if len(words) < length:
        return none, none, none, none.astype(U)
    if len(words) >> PLACE:
        raise ValueError("too many words in one block")
    seeds = run_hashes(words, SEED)
    rank = (seeds >> U(PLACE)) << U(PLACE) | np.arange(len(seeds), dtype=U)
    place = (sliding_min(rank, length - SEED + 1) & U((1 << PLACE) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    inside = np.flatnonzero(np.arange(length, length + len(place)) <= ends[doc])
    if not len(inside):
        return none, none, none, none.astype(U)
    place, doc = place[inside], doc[inside]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(place)] - 1
    begin = (ends - sizes)[doc[first]]
    h = seeds[place[first]] * U(0xA24BAED4963EE407)  # least hashes are small numbers: spread them
    return doc[first], inside[first] - begin, inside[last] - begin, h ^ (h >> U(32))


def repeated_windows(ids: np.ndarray, stretches: list[tuple[int, int, bool]], length: int) -> list[list[tuple[int, int]]]:
    """Parses each stretch (begin, end, seen twice) of ``ids`` relative to those before it; runs of repeated windows in each.

    The index holds every different window of the reference. Where a window is found there, the match is followed as far as
    it goes: a factor, all of whose windows are repeated, on both sides. Parsing goes on with the first window across the
    factor's end. A window that is not found joins the reference.
    """
    h = run_hashes(mixed((ids.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)), length).tolist() if len(ids) >= length else []
    index: dict[int, tuple[int, int]] = {}  # a window's hash: its place and the end of its stretch
    mark = np.zeros(len(ids) + 1, bool)
    for begin, end, twice in stretches:
        q = begin
        if twice:
            mark[begin : end - length + 1] = True
        while q + length <= end:
            key, found = h[q], None
            while known := index.get(key):  # windows that share a hash lie at the next keys
                r, r_end = known
                n = min(end - q, r_end - r)
                apart = np.flatnonzero(ids[q : q + n] != ids[r : r + n])
                n = int(apart[0]) if len(apart) else n
                if n >= length:
                    found = n
                    break
                key += 1
            if found is None:
                index[key] = q, end
                q += 1
            else:
                step = found - length + 1
                mark[q : q + step] = True
                mark[r : r + step] = True
                q += step
    out = []
    for begin, end, _ in stretches:
        edge = np.flatnonzero(np.diff(np.r_[False, mark[begin : max(begin, end - length + 1)], False].astype(np.int8)))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist())))
    return out


def remove_passages(
    docs: DataFrame, length: int = 35, block_bytes: int = 2_000_000, bucket_bytes: int = 16_000_000, parts: int = 16, hot: int = 4096, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row.

    Words are separated by the six ASCII white characters. A word goes when ``length`` consecutive words that cover it occur
    anywhere else too, in the same document or another: all copies go. Windows are judged on the input and never cross rows.

    Documents are dealt to blocks by a hash of id and text. (1) Each block sends its different anchors with their counts to
    buckets, which return for each whether it is unique, shared, or hot (``hot`` places or more). (2) The stretches of words
    around shared anchors go to ``parts`` reference blocks a bucket, where they are parsed against one another; a stretch that
    a block holds twice is settled there and sent once. At a hot anchor each window goes by its own hash, so surroundings
    that differ are dealt out and windows that are equal still meet. (3) Each block cuts the repeated windows out. The texts
    move once, to their block, and that exchange is reused. Words are compared themselves, hashes only lead to them.

    Null texts have no words; texts of any length count whole. Rows with null or repeated ids are documents of their own. An
    empty table gives an empty result. Other columns are ignored. ``length`` is at least 16; a block holds a billion words
    at most.
    """
    if length < SEED + 4:
        raise ValueError(f"length must be {SEED + 4} at least")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)))

    def pack_anchors(rows):
        import pandas as pd

        _, words = _ordered(rows)
        _, _, _, h = anchors(*_hashed(words), length)
        own = [(int(rows["block"].iloc[0]), k, v.astype("<u4").tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes()) for k, v, n in _by_bucket(h, buckets)]
        return pd.DataFrame(own, columns=["block", "bucket", "hashes", "counts"])

    packed = base.groupBy("block").applyInPandas(pack_anchors, "block long, bucket long, hashes binary, counts binary")

    def judge_anchors(rows):
        import pandas as pd

        h = np.concatenate([np.frombuffer(x, "<u4") for x in rows["hashes"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["counts"]])
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, n)[at]
        kind = np.where(total < 2, UNIQUE, np.where(total < hot, SHARED, HOT)).astype(np.uint8)
        cuts = np.cumsum([0, *(len(x) // 4 for x in rows["hashes"])])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "kinds": [kind[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    kinds = packed.groupBy("bucket").applyInPandas(judge_anchors, "block long, bucket long, kinds binary")

    def stretches(rows, kinds):
        return _stretches(rows, dict(zip(kinds["bucket"], kinds["kinds"])), length, buckets, parts)

    found = base.groupBy("block").cogroup(kinds.groupBy("block")).applyInPandas(stretches, "part long, block long, docs binary, firsts binary, lasts binary, twice binary, words binary")

    def parse(rows):
        return _parsed(rows, length)

    spans = found.groupBy("part").applyInPandas(parse, "block long, docs binary, firsts binary, lasts binary")

    def cut(rows, spans):
        import pandas as pd

        ids, words = _ordered(rows)
        get = lambda c: np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, "<i8") for x in spans[c])]).astype(np.int64)
        doc, a, z = get("docs"), get("firsts"), get("lasts")
        order = np.argsort(doc, kind="stable")
        doc, a, z = doc[order], a[order], z[order]
        at = np.searchsorted(doc, np.arange(len(words) + 1))
        left = [_without(w, a[i:j], z[i:j] + length) for w, i, j in zip(words, at, at[1:])]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": [len(w) for w in words], "n_removed": [len(w) - len(k) for w, k in zip(words, left)], "kept_text": [b" ".join(k) for k in left]})

    out = base.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept_text binary")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.col("kept_text").cast("string").alias("kept_text"))


def _ordered(rows) -> tuple[list, list[list[bytes]]]:
    """Ids (None where null) and words of a block's documents in an order that does not depend on how its rows arrived."""
    ids = [None if x is None or x != x else int(x) for x in rows["doc_id"]]
    both = sorted(zip(ids, rows["t"]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in both], [bytes(r[1]).split() for r in both]


def _hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    known = WordHashes()
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((known[x] for w in words for x in w), U, int(sizes.sum())), sizes


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per bucket: its number, and the different hashes and their counts, in order."""
    v, n = np.unique(h, return_counts=True)  # buckets go by the high bits, so they lie together
    if not len(v):
        return []
    bucket = _bucket(v, buckets)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return [(int(bucket[a]), v[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]


def _stretches(rows, kinds: dict, length: int, buckets: int, parts: int):
    """Rows of stretches by reference block, and one of spans that are settled here: words a block holds twice."""
    import pandas as pd

    names = ["part", "block", "docs", "firsts", "lasts", "twice", "words"]
    if not len(rows) or not len(kinds):
        return pd.DataFrame(columns=names)
    block = int(rows["block"].iloc[0])
    _, words = _ordered(rows)
    doc, first, last, h = anchors(*_hashed(words), length)
    own = _by_bucket(h, buckets)
    known, kind = np.concatenate([v for _, v, _ in own]), np.concatenate([np.frombuffer(kinds[k], np.uint8) for k, _, _ in own])
    kind = kind[np.searchsorted(known, h)]
    pick = np.flatnonzero(kind)
    doc, first, last, h, kind = doc[pick], first[pick], last[pick], h[pick], kind[pick]
    windows = np.where(kind == HOT, last - first + 1, 1)  # a stretch for each window of a hot anchor
    at = np.repeat(np.arange(len(pick)), windows)
    step = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    hot = kind[at] == HOT
    doc, first, last, h = doc[at], first[at] + step, np.where(hot, first[at] + step, last[at]), h[at]
    places: dict[tuple[int, bytes], list] = {}
    target = (_bucket(h, buckets) * parts + ((h >> U(8)) & U(0xFFFF)).astype(np.int64) % parts).tolist()
    for d, a, z, k, by_window in zip(doc.tolist(), first.tolist(), last.tolist(), target, hot.tolist()):
        s = b" ".join(words[d][a : z + length])
        if by_window:
            import xxhash

            k = xxhash.xxh3_64_intdigest(s) % (buckets * parts)
        places.setdefault((k, s), []).append((d, a, z))
    sent: dict[int, list] = {}
    settled = []
    for (k, s), own in places.items():
        sent.setdefault(k, []).append((*own[0], len(own) > 1, s))
        if len(own) > 1:
            settled += own
    column = lambda x, j, t="<i8": np.array([e[j] for e in x], t).tobytes()
    out = [(k, block, column(x, 0), column(x, 1), column(x, 2), column(x, 3, np.uint8), b"\n".join(e[4] for e in x)) for k, x in sent.items()]
    if settled:
        out.append((-1 - block, block, column(settled, 0), column(settled, 1), column(settled, 2), b"", b""))
    return pd.DataFrame(out, columns=names)


def _parsed(rows, length: int):
    """(block, docs, firsts, lasts): runs of windows that occur elsewhere, among the stretches of a reference block."""
    import pandas as pd

    names = ["block", "docs", "firsts", "lasts"]
    if rows["part"].iloc[0] < 0:
        return rows[names]
    rows = rows.sort_values("block")
    numbers: dict[bytes, int] = {}
    ids, spots, whose, at = [], [], [], 0
    for block, docs, firsts, twice, text in zip(rows["block"], rows["docs"], rows["firsts"], rows["twice"], rows["words"]):
        for d, a, two, s in zip(np.frombuffer(docs, "<i8").tolist(), np.frombuffer(firsts, "<i8").tolist(), np.frombuffer(twice, np.uint8).tolist(), bytes(text).split(b"\n")):
            w = [numbers.setdefault(x, len(numbers)) for x in s.split(b" ")]
            ids += w
            spots.append((at, at + len(w), bool(two)))
            whose.append((int(block), d, a))
            at += len(w)
    found = repeated_windows(np.array(ids, np.int64), spots, length)
    out: dict[int, list] = {}
    for (block, d, a), (_, _, two), runs in zip(whose, spots, found):
        if not two:  # its block knows already
            out.setdefault(block, []).extend((d, a + x, a + y) for x, y in runs)
    done = [(b, *(np.array([e[j] for e in x], "<i8").tobytes() for j in range(3))) for b, x in out.items() if x]
    return pd.DataFrame(done, columns=names)


def _without(words: list[bytes], a: np.ndarray, z: np.ndarray) -> list[bytes]:
    if not len(a):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, z, -1)
    keep = np.cumsum(edge[:-1]) <= 0
    return [words[i] for i in np.flatnonzero(keep)]


#: The same in DuckDB SQL, every window written out.
PASSAGES_SQL = r"""
with d as (select row_number() over (order by doc_id) as nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select nr, w, unnest(range(1, len(w) - 33)) as p from d),
h as (select nr, p, array_to_string(w[p : p + 34], ' ') as words from s),
c as (select words from h group by words having count(*) > 1),
r as (select h.nr, unnest(range(p, p + 35)) as gone from h join c using (words)),
g as (select nr, list(distinct gone) as gone from r group by nr),
k as (select d.*, len(coalesce(gone, [])) as n_removed, list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)) as kept from d left join g using (nr))
select doc_id, len(w) as n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
