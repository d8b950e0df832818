"""Removal of long byte strings that an earlier document also has, by sorting suffixes of anchored stretches.

Anchors are minimisers: of the hashes of the SEED-byte strings inside any LENGTH-byte window, the least marks a place, and
equal windows mark the same place. An anchor that only one document has can lie in no repeated window, so only the
windows of shared anchors are sorted: multikey quicksort to a shallow depth, then blind tries for what still ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of an anchor's hashed string.
SEED = 24


def seed_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the SEED-byte strings of a byte array, built by doubling (1, 2, 4, 8, 16 and 8 more)."""
    h = (b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    at = {1: h}
    for w, m in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F), (4, 0xE7037ED1A0B428DB), (8, 0x8EBC6AF09C88C6E3)):
        h = at[w]
        h = h[:-w] * U(m) + (h[w:] ^ (h[w:] >> U(29)))
        at[2 * w] = h
    n = len(b) - SEED + 1
    h = at[16][:n] * U(0x589965CC75374CC3) + at[8][16 : 16 + n]
    h = (h ^ (h >> U(32))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(29))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every run of ``w`` entries."""
    k, out = 1, h
    while 2 * k <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    if k < w:
        out = np.minimum(out[: len(h) - w + 1], out[w - k : w - k + len(h) - w + 1])
    return out


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose least hash is the same: index of the text, first and last start of the run, the hash."""
    out: list[list] = [[], [], [], []]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= 1 << 18):  # short texts share the array work
            size += len(texts[stop])
            stop += 1
        if size >= length:
            sizes = np.array([len(t) for t in texts[at:stop]])
            ends = np.cumsum(sizes)
            low = sliding_min(seed_hashes(np.frombuffer(b"".join(texts[at:stop]), np.uint8)), length - SEED + 1)
            doc = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
            inside = np.flatnonzero(np.arange(length, length + len(low)) <= ends[doc])
            if len(inside):
                low, doc = low[inside], doc[inside]
                first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                last = np.r_[first[1:], len(low)] - 1
                begin = (ends - sizes)[doc[first]]
                for o, x in zip(out, (doc[first] + at, inside[first] - begin, inside[last] - begin, low[first])):
                    o.append(x)
        at = stop
    kinds = (np.int64, np.int64, np.int64, U)
    doc, first, last, h = (np.concatenate([np.empty(0, k), *o]).astype(k, copy=False) for k, o in zip(kinds, out))
    h = h * U(0xA24BAED4963EE407)  # least hashes are small numbers: spread them, since buckets go by the high bits
    return doc, first, last, h ^ (h >> U(32))


def keyed_words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number that orders like the bytes. ``buf`` is padded by 8."""
    v = np.zeros(len(buf) - 7, U)
    for i in range(8):
        v = v << U(8) | buf[i : len(buf) - 7 + i].astype(U)
    return v


def equal_groups(buf: np.ndarray, places: np.ndarray, length: int, shallow: int = 16) -> np.ndarray:
    """Group numbers of the ``length``-byte strings at ``places``, equal exactly for equal strings, in suffix order.

    Shallow part: multikey quicksort by 8-byte characters, group within group, down to ``shallow`` bytes. Deep part:
    groups that still tie go through blind tries, all groups level by level: a group's first differing byte is found
    against its first member, members are told apart by that byte alone, and groups equal to the end are leaves.
    """
    n = len(places)
    if not n:
        return np.empty(0, np.int64)
    words = keyed_words(buf)
    order = np.argsort(words[places])
    key = words[places[order]]
    cut = np.r_[True, key[1:] != key[:-1]]
    depth = 8
    while depth < shallow:
        group = np.cumsum(cut) - 1
        at = np.flatnonzero(np.bincount(group)[group] > 1)
        key = words[places[order[at]] + depth]
        sub = np.lexsort((key, group[at]))
        order[at], key = order[at][sub], key[sub]
        cut[at[1:]] |= (key[1:] != key[:-1]) & (at[1:] == at[:-1] + 1)
        depth += 8
    group = np.cumsum(cut) - 1
    active = np.flatnonzero(np.bincount(group)[group] > 1)  # places in the order; groups lie together
    group = group[active]
    while len(active):
        head = np.r_[True, group[1:] != group[:-1]]
        starts, number = np.flatnonzero(head), np.cumsum(head) - 1
        own = places[order[active]]
        lead = own[starts][number]
        common = np.full(len(active), length)
        for d in range(shallow, length, 8):
            d = min(d, length - 8)
            x = words[own + d] ^ words[lead + d]
            differ = np.flatnonzero((x != 0) & (common == length))
            y, same = x[differ], np.full(len(differ), d)
            for bits in (32, 16, 8):  # leading zero bytes of the difference
                small = y >> U(64 - bits) == 0
                same += np.where(small, bits // 8, 0)
                y = np.where(small, y << U(bits), y)
            common[differ] = same
        branch = np.minimum.reduceat(common, starts)[number]
        inner = branch < length  # the other groups are leaves
        active, number = active[inner], number[inner]
        char = buf[own[inner] + branch[inner]]
        sub = np.lexsort((char, number))
        order[active], char = order[active][sub], char[sub]
        split = (char[1:] != char[:-1]) & (number[1:] == number[:-1])
        cut[active[1:]] |= split
        group = np.cumsum(np.r_[False, (number[1:] != number[:-1]) | split]) if len(active) else number
        if len(active):
            more = np.bincount(group)[group] > 1
            active, group = active[more], group[more]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(cut) - 1
    return out


def _split(blob: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


def remove_repeats(
    docs: DataFrame, length: int = 50, block_bytes: int = 2_000_000, bucket_bytes: int = 24_000_000, parts: int = 32, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (bytes) of every row.

    A byte goes when a ``length``-byte string that covers it also starts in a document with a smaller id. Texts are
    UTF-8 bytes (null: empty); strings are judged on the input and never cross documents.

    Documents are dealt to blocks by a hash of id and text. (1) Each block sends the low 32 bits of its anchors' hashes
    to the buckets of the other bits, which return one bit an anchor: whether another document has it. (2) The stretches
    around shared anchors go to ``parts`` parts a bucket, where their suffixes are sorted and runs of windows that a
    smaller id also has are returned. (3) Each block cuts them out. The texts move once, to their block, and that
    exchange is reused. A stretch that equals one of a smaller id in its block is settled there, so a passage that a
    third of all documents hold costs a bucket one entry a block.

    Rows with a null id neither lose nor take anything; rows repeating an id are not earlier than one another. An empty
    table gives an empty result. Other columns are ignored. ``length`` is at least 32.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)))

    def pack_anchors(rows):
        import pandas as pd

        _, texts = _ordered(rows)
        out = []
        for k, _, h in _by_bucket(texts, length, buckets)[0]:
            out.append((int(rows["block"].iloc[0]), k, (h & U(0xFFFFFFFF)).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "hashes"])

    packed = base.groupBy("block").applyInPandas(pack_anchors, "block long, bucket long, hashes binary")

    def shared_anchors(rows):
        import pandas as pd

        h = np.concatenate([np.frombuffer(x, "<u4") for x in rows["hashes"]])
        s = np.sort(h)  # a document sends a hash once, so a repeated one is another document's
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        hit = np.zeros(len(h), bool)
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        cuts = np.cumsum([0, *(len(x) // 4 for x in rows["hashes"])])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "bits": [np.packbits(x).tobytes() for x in _split(hit, cuts)]})

    bits = packed.groupBy("bucket").applyInPandas(shared_anchors, "block long, bucket long, bits binary")

    def stretches(rows, bits):
        return _stretches(rows, dict(zip(bits["bucket"], bits["bits"])), length, buckets, parts)

    context = "bucket long, block long, hashes binary, doc_ids binary, docs binary, firsts binary, sizes binary, bytes binary"
    found = base.groupBy("block").cogroup(bits.groupBy("block")).applyInPandas(stretches, context)

    def sort_bucket(rows):
        return _repeated(rows, length)

    spans = found.groupBy("bucket").applyInPandas(sort_bucket, "block long, docs binary, firsts binary, lasts binary")

    def cut(rows, spans):
        import pandas as pd

        ids, texts = _ordered(rows)
        get = lambda c: np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, "<i8") for x in spans[c])]).astype(np.int64)
        doc, a, z = get("docs"), get("firsts"), get("lasts")
        order = np.argsort(doc, kind="stable")
        doc, a, z = doc[order], a[order], z[order]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        got = [_without(t, a[i:j], z[i:j] + length) for t, i, j in zip(texts, at, at[1:])]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_bytes": [len(t) for t in texts], "n_removed": [g[1] for g in got], "n_spans": [g[2] for g in got], "kept_text": [g[0] for g in got]})

    out = base.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")


def _ordered(rows) -> tuple[list, list[bytes]]:
    """Ids (None where null) and texts of a block in an order that does not depend on how its rows arrived."""
    ids = [None if x is None or x != x else int(x) for x in rows["doc_id"]]
    both = sorted(zip(ids, rows["t"]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in both], [bytes(r[1]) for r in both]


def _by_bucket(texts: list[bytes], length: int, buckets: int) -> tuple[list[tuple], tuple]:
    """Per bucket: its number, and text index and hash of each distinct (text, hash), ordered; and the anchors."""
    found = anchors(texts, length)
    doc, _, _, h = found
    bucket = _bucket(h, buckets)
    order = np.lexsort((h, doc, bucket))
    d, v, k = doc[order], h[order], bucket[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])][: len(d)]
    d, v, k = d[new], v[new], k[new]
    cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.array([0])
    return [(int(k[a]), d[a:b], v[a:b]) for a, b in zip(cuts, cuts[1:])], found


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def _stretches(rows, bits: dict, length: int, buckets: int, parts: int):
    """Rows of stretches: for each run of windows at a shared anchor, the bytes from its first window to its last's end."""
    import pandas as pd

    names = ["bucket", "block", "hashes", "doc_ids", "docs", "firsts", "sizes", "bytes"]
    if not len(rows) or not len(bits):
        return pd.DataFrame(columns=names)
    block = int(rows["block"].iloc[0])
    ids, texts = _ordered(rows)
    own, (doc, first, last, h) = _by_bucket(texts, length, buckets)
    shared = [v[np.unpackbits(np.frombuffer(bits[k], np.uint8))[: len(v)].astype(bool)] for k, _, v in own]
    pick = np.flatnonzero(np.isin(h, np.unique(np.concatenate(shared))))
    doc, first, last, h = doc[pick], first[pick], last[pick], h[pick]
    target = _bucket(h, buckets) * parts + (h >> U(32) & U(0xFF)).astype(np.int64) % parts
    out: dict[int, list] = {}
    earlier: dict[bytes, int] = {}
    settled = []
    for d, a, z, v, k in zip(doc.tolist(), first.tolist(), last.tolist(), h.tolist(), target.tolist()):
        if ids[d] is None:
            continue
        s = texts[d][a : z + length]
        if earlier.setdefault(s, ids[d]) < ids[d]:  # documents come in the order of their ids
            settled.append((d, a, z))
        else:
            out.setdefault(k, []).append((v, ids[d], d, a, s))
    done = [(k, block, *(np.array([e[j] for e in x], t).tobytes() for j, t in ((0, "<u8"), (1, "<i8"), (2, "<i8"), (3, "<i8"))), np.array([len(e[4]) for e in x], "<i8").tobytes(), b"".join(e[4] for e in x)) for k, x in out.items()]
    if settled:  # passed through: no stretch to compare, only spans
        s = np.array(settled, "<i8")
        done.append((-1 - block, block, b"", b"", s[:, 0].tobytes(), s[:, 1].tobytes(), s[:, 2].tobytes(), b""))
    return pd.DataFrame(done, columns=names)


def _repeated(rows, length: int):
    """(block, docs, firsts, lasts): runs of windows that a smaller id also has, among the stretches of a bucket."""
    import pandas as pd

    names = ["block", "docs", "firsts", "lasts"]
    if rows["bucket"].iloc[0] < 0:
        return rows[["block", "docs", "firsts", "sizes"]].set_axis(names, axis=1)
    get = lambda c, d: np.concatenate([np.frombuffer(x, d) for x in rows[c]])
    ids, docs, firsts, sizes, hashes = get("doc_ids", "<i8"), get("docs", "<i8"), get("firsts", "<i8"), get("sizes", "<i8"), get("hashes", "<u8")
    block = np.repeat(rows["block"].to_numpy(), [len(x) // 8 for x in rows["firsts"]])
    buf = np.frombuffer(b"".join(rows["bytes"]) + b"\0" * 8, np.uint8)
    begin = np.cumsum(sizes) - sizes
    _, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[number] > 1)
    windows = sizes[at] - length + 1
    owner = np.repeat(at, windows)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = equal_groups(buf, begin[owner] + shift, length)
    if not len(group):
        return pd.DataFrame(columns=names)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[owner])
    hit = least[group] < ids[owner]
    owner, shift = owner[hit], shift[hit]
    if not len(owner):
        return pd.DataFrame(columns=names)
    s = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1] + 1)])
    e = np.r_[s[1:], len(owner)] - 1
    who = owner[s]
    a, z = firsts[who] + shift[s], firsts[who] + shift[e]
    order = np.argsort(block[who], kind="stable")
    who, a, z = who[order], a[order], z[order]
    b = block[who]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
    pieces = [[x.astype("<i8").tobytes() for x in _split(v, cuts)] for v in (docs[who], a, z)]
    return pd.DataFrame(dict(zip(names, [b[cuts[:-1]], *pieces])))


def _without(t: bytes, a: np.ndarray, z: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes left, how many went, and in how many maximal runs."""
    if not len(a):
        return t, 0, 0
    edge = np.zeros(len(t) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, z, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(t, np.uint8)[~gone].tobytes(), int(gone.sum()), runs
