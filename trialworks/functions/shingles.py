"""Loose texts, sketches of their k-grams and comparisons of those, for whole batches in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Of each byte of lower-case UTF-8 its byte in a loose text: letters stay, digits are #, all others blanks.
LOOSE = np.full(256, 32, np.uint8)
LOOSE[97:123], LOOSE[48:58] = np.arange(97, 123), 35
CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
P = np.uint32((1 << 31) - 1)
LOW, LANE = np.uint64(0x00FF00FF00FF00FF), np.uint64(0xFFFF)


def loose(texts) -> list[bytes]:
    """What :func:`text.norm_loose` gives for an Arrow array of texts that are in lower case already; empty for null."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    b, at = LOOSE[data], at - at[0]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != b[:-1]) | (b[1:] > 35)  # runs of digits and of blanks are one
    keep[at[:-1][at[:-1] < len(b)]] = True
    at, b = np.concatenate([[0], np.cumsum(keep)])[at], b[keep].tobytes()
    return [b[i:j].strip(b" ") for i, j in zip(at[:-1], at[1:])]


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on as a number."""
    c = data[: len(data) - k + 1].astype(np.int64)
    for i in range(1, k):
        c = c << 8 | data[i : len(data) - k + 1 + i]
    return c


def codes(text: str, k: int) -> np.ndarray | None:
    """The distinct k-grams of a text as numbers in rising order; None where they don't fit."""
    if not text.isascii() or len(text) < k or k > 7:
        return None
    c = np.sort(_codes(np.frombuffer(text.encode(), np.uint8), k))
    return c[np.concatenate([[True], c[1:] != c[:-1]])]


def _crc32(c: np.ndarray, k: int) -> np.ndarray:
    crc = np.full(len(c), 0xFFFFFFFF, np.uint32)
    for i in reversed(range(k)):
        crc = CRC[(crc ^ (c >> (8 * i)).astype(np.uint32)) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def _hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each text's distinct k-grams, text by text, and how many a text has."""
    found, of = [], np.zeros(len(texts), np.int64)
    fast = [i for i, t in enumerate(texts) if len(t) >= k and t.isascii()] if k <= 5 else []
    if fast:
        sizes = np.array([len(texts[i]) for i in fast])
        c = _codes(np.frombuffer(b"".join(texts[i] for i in fast), np.uint8), k)
        text = np.repeat(np.arange(len(fast)), sizes)
        inside = np.arange(len(text)) + k <= np.repeat(np.cumsum(sizes), sizes)
        inside = inside[: len(c)]
        c = np.sort(text[: len(c)][inside] << 8 * k | c[inside])
        c = c[np.concatenate([[True], c[1:] != c[:-1]])]
        of[fast] = np.bincount(c >> 8 * k, minlength=len(fast))
        crc = _crc32(c & ((1 << 8 * k) - 1), k)
        found = dict(zip(fast, np.split(crc, np.cumsum(of[fast])[:-1])))
        if len(fast) == len(texts):
            return crc, of
    else:
        found = {}
    for i, t in enumerate(texts):
        if i not in found:
            s = t.decode()
            grams = {s[j : j + k] for j in range(len(s) - k + 1)} if len(s) >= k else ({s} if s else set())
            found[i] = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint32)
            of[i] = len(found[i])
    return np.concatenate([found[i] for i in range(len(texts))] or [np.zeros(0, np.uint32)]), of


def sketches(texts: list[bytes], params: list[tuple[int, int]], k: int, at_once: int = 32_768) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The columns of :func:`duplicates.sketch` for texts in UTF-8."""
    crc, of = _hashes(texts, k)
    ends = np.cumsum(of)
    h = (crc & P) + (crc >> np.uint32(31))
    h = np.minimum(h, h - P).astype(np.uint64)
    m, some = np.zeros((len(texts), len(params)), np.int64), np.flatnonzero(of)
    starts, first = (ends - of)[some], 0
    while first < len(some):  # texts of some at_once k-grams
        last = max(first + 1, int(np.searchsorted(ends[some], starts[first] + at_once, "right")))
        part, at = h[starts[first] : ends[some[last - 1]]], starts[first:last] - starts[first]
        for i, (a, b) in enumerate(params):
            x = part * np.uint64(a)
            x += np.uint64(b)
            y = (x >> np.uint64(31)).astype(np.uint32)
            y += x.astype(np.uint32) & P  # below 2 P
            m[some[first:last], i] = np.minimum.reduceat(np.minimum(y, y - P), at)
        first = last
    width = np.array([1 << max(3, (int(n) // 8).bit_length()) for n in of], np.int64)
    base = np.cumsum(width) - width
    counts = np.bincount(np.repeat(base, of) + (crc & np.repeat(width - 1, of)), minlength=int(width.sum()))
    held = np.minimum(counts, 255).astype(np.uint8).tobytes()
    over = np.add.reduceat(np.maximum(counts - 255, 0), base) if len(texts) else []
    bins = [int(o).to_bytes(8, "little") + held[i : i + w] for o, i, w in zip(over, base, width)]
    return m, of, bins


def least_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the lesser bytes of two tables' rows, of 8 bytes or a multiple."""
    out = np.zeros(len(x), np.int64)
    for i in range(0, x.shape[1], 1024):  # two bytes hold the sums of 1,024
        v = np.minimum(x[:, i : i + 1024], y[:, i : i + 1024]).view(np.uint64)
        w = v & LOW
        w += v >> np.uint64(8) & LOW
        w = w.sum(1)
        out += sum((w >> np.uint64(s) & LANE).astype(np.int64) for s in (0, 16, 32, 48))
    return out


class Bucket:
    """Rows of whole groups (key, p, q) in order of size, as duplicates' buckets have them; see duplicates._meeting."""

    def __init__(self, t, similarity: float):
        col = lambda c: t.column(c).to_numpy()
        self.similarity, self.row, self.size, self.label, self.own = similarity, col("row"), col("size"), col("label"), col("own")
        self.meet, self.cross, self.first = col("meet").astype(bool), col("p") != col("q"), self.starts(t)
        bins = t.column("bins").combine_chunks()
        at = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + len(bins) + 1].astype(np.int64)
        data = np.frombuffer(bins.buffers()[2], np.uint8)
        self.width, self.slot, self.over, self.tables = np.diff(at) - 8, np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64), {}
        for w in np.unique(self.width):
            of = np.flatnonzero(self.width == w)
            whole = data[at[of][:, None] + np.arange(w + 8)]
            self.slot[of], self.over[of] = np.arange(len(of)), np.ascontiguousarray(whole[:, :8]).view("<i8")[:, 0]
            self.tables[w, w] = np.ascontiguousarray(whole[:, 8:])
            self.tables[w, w // 2] = np.minimum(whole[:, 8:].reshape(-1, 2, w // 2).sum(1), 255).astype(np.uint8)  # as bins of half as many

    @staticmethod
    def starts(t) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in ("key", "p", "q"):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def pairs(self, at_once: int = 262_144):
        import pyarrow as pa

        n = len(self.row)
        group = np.zeros(n, np.int64)
        group[self.first[1:]] = 1
        group = np.cumsum(group) << 40
        key = group + self.size  # rising
        least, most = np.floor(self.size * self.similarity).astype(np.int64) - 1, np.ceil(self.size / self.similarity).astype(np.int64) + 1
        lo, hi = np.searchsorted(key, group + np.maximum(least, 0), "left"), np.searchsorted(key, group + most, "right")
        if self.meet.all():
            lo = np.arange(1, n + 1)  # each pair from its first row
        i = np.flatnonzero(self.meet & (hi > lo))
        ends = np.cumsum(hi[i] - lo[i])
        first, done = 0, 0
        while first < len(i):
            last = max(first + 1, int(np.searchsorted(ends, done + at_once, "right")))
            of = i[first:last]
            x = np.repeat(of, hi[of] - lo[of])
            y = np.arange(len(x)) - np.repeat(ends[first:last] - (hi[of] - lo[of]) - done, hi[of] - lo[of]) + np.repeat(lo[of], hi[of] - lo[of])
            ok = (self.label[x] != self.label[y]) & (~self.meet[y] | (x < y)) & (~self.cross[x] | (self.own[x] != self.own[y])) & (x != y)
            x, y = self.near(x[ok], y[ok])
            if len(x):
                a, b = self.row[x], self.row[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            first, done = last, ends[last - 1]

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows that may reach the similarity."""
        found = [(x[:0], y[:0])]
        x, y = np.where(self.width[x] <= self.width[y], x, y), np.where(self.width[x] <= self.width[y], y, x)
        for w in np.unique(self.width[x]):
            for v in (w, 2 * w):  # texts of other sizes are further apart
                of = np.flatnonzero((self.width[x] == w) & (self.width[y] == v))
                step = max(1, 2_000_000 // int(w))
                for part in (of[j : j + step] for j in range(0, len(of), step)):
                    p, q = x[part], y[part]
                    most = least_sums(self.tables[w, w][self.slot[p]], self.tables[v, w][self.slot[q]]) + np.minimum(self.over[p], self.over[q])
                    ok = most + 1e-6 >= (self.size[p] + self.size[q] - most) * self.similarity
                    found.append((p[ok], q[ok]))
        return tuple(np.concatenate(z) for z in zip(*found))
