"""The numbers of :func:`stats.hash01` for whole arrays of messages, in numpy."""

from __future__ import annotations

import math

import numpy as np

SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)  # RFC 1321
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def hash01(messages: np.ndarray) -> np.ndarray:
    """The first 52 bits of each row's MD5 over 2**52. ``messages`` are rows of bytes of one length."""
    n, length = messages.shape
    blocks = (length + 8) // 64 + 1
    m = np.zeros((n, blocks * 64), np.uint8)
    m[:, :length] = messages
    m[:, length] = 128
    m[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(m.view("<u4").T)
    state = [np.full(n, s, np.uint32) for s in START]
    for k in range(blocks):
        a, b, c, d = state
        for i in range(64):
            kind = i // 16
            if kind == 0:
                f, g = d ^ (b & (c ^ d)), i
            elif kind == 1:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif kind == 2:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), (7 * i) % 16
            f += a
            f += words[16 * k + g]
            f += SINES[i]
            s = SHIFTS[kind][i % 4]
            high = f << np.uint32(s)
            f >>= np.uint32(32 - s)
            f |= high
            f += b
            a, d, c, b = d, c, b, f
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return (state[0].byteswap().astype(np.float64) * 2.0**20 + (state[1].byteswap() >> np.uint32(12))) / 2.0**52


def hash01_draws(keys: list[bytes], draws: int, seed: int, at_once: int = 16_384) -> np.ndarray:
    """hash01 of "key/draw" and a seed, a row per key and a column per draw from 1 on."""
    out, lengths = np.empty((len(keys), draws)), np.array([len(k) for k in keys])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        heads = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), length)
        first = 1
        while first <= draws:  # draws of equally many digits
            last = min(draws, 10 ** len(str(first)) - 1)
            tails = np.frombuffer("".join(f"/{i}|{seed}" for i in range(first, last + 1)).encode(), np.uint8).reshape(last - first + 1, -1)
            step = max(1, at_once // len(tails))
            for i in range(0, len(rows), step):
                h = heads[i : i + step]
                m = np.concatenate([np.repeat(h, len(tails), 0), np.tile(tails, (len(h), 1))], 1)
                out[rows[i : i + step], first - 1 : last] = hash01(m).reshape(len(h), len(tails))
            first = last + 1
    return out
