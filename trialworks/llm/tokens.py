"""Token counts and ids of whole texts, by cached units whose independence the vocabulary proves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Distinct units that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Distinct stretches, and characters of them, that a worker remembers for word ids.
STRETCHES = 600_000
STRETCH_CHARS = 16_000_000


class UnitCounts(dict):
    """Tokens of each unit. A unit without a leading newline carries the word mark; "\\nX" is a newline, then X."""

    def __init__(self, model_path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.encode = self.model.encode
        self.proved, multi = {}, set()
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i):
                continue
            if SPACE in piece.lstrip(SPACE) or "\n" in piece or " " in piece:
                multi.add(piece)  # a merge could cross a cut
            elif piece[0] == SPACE and len(piece) > 1 and piece[1] != SPACE and self.encode(piece[1:]) == [i]:
                self.proved[piece[1:]] = 1  # this string alone is one token: counted without merging
        self.exact = not multi
        self.update(self.proved)

    def __missing__(self, unit: str) -> int:
        if len(self) > REMEMBERED + len(self.proved):
            self.clear()
            self.update(self.proved)
        n = len(self.encode(unit)) - (unit[:1] == "\n")
        if len(unit) <= 64:
            self[unit] = n
        return n

    def spaced(self, unit: str) -> int:
        """A unit as it stands in the text: a run of word marks and what follows, or a newline and what follows."""
        if unit[0] == "\n":
            return self[unit]
        return 1 if unit == SPACE else self[unit[1:]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.exact:
            return len(self.encode(text))
        parts = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.spaced, re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", marked)))


@lru_cache(2)
def unit_counts(model_path: str) -> UnitCounts:
    return UnitCounts(model_path)


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of a text under a sentencepiece BPE model, without begin or end tokens; null and empty count 0.

    Units are cut before each run of spaces and before each newline. The vocabulary is searched once for a piece that
    could span such a cut; if one is found, whole texts are encoded instead. Units that the vocabulary proves to be a
    single token are counted directly, and only the rest is merged, once per distinct unit and worker.
    """

    @F.pandas_udf(T.LongType())
    def count(texts):
        return texts.map(unit_counts(model_path).count).astype("int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. Repeated rows and ids stay; other columns are ignored."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(doc_id), F.octet_length(whole).cast("long").alias("n_bytes"), token_count(F.col(text), model_path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def byte_letters() -> dict[int, str]:
    """What byte-level BPE writes for each letter of Latin-1 beyond ASCII: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


#: A letter and a sign after it. The tokenizer splits there before its merges, unless the sign is an apostrophe.
LETTER_AND_SIGN = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{-~])"
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class WordIds:
    """Ids of texts, put together from the ids of their distinct stretches between spaces, newlines and signs.

    White space is dropped by this tokenizer before its merges, so stretches between it are independent. A worker
    remembers up to :data:`STRETCHES` of them (or :data:`STRETCH_CHARS` characters) and then starts afresh.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_path)
        self.encode, self.encode_batch, self.merge = model.encode, model.encode_batch, model.model.tokenize
        assert all("<|" in t.content for t in model.get_added_tokens_decoder().values())
        self.signs = byte_letters()
        self.top = max(model.get_vocab().values())
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.first, self.n, self.chars = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """The number of each of these distinct stretches; those not known are learnt."""
        if len(self.number) + len(stretches) > STRETCHES or self.chars > STRETCH_CHARS:
            self.clear()
        at = np.fromiter(map(self.number.get, stretches, repeat(-1)), np.int64, len(stretches))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.n), len(self.n) + len(new))
            self.learn([stretches[i] for i in new])
        return at

    def learn(self, new: list[str]) -> None:
        merge, signs, ids, other = self.merge, self.signs, [], []
        for i, w in enumerate(new):
            if len(w) <= 64 and LETTERS.fullmatch(w):  # one pre-token that normalising leaves as it is: only the merges run
                ids.append([t.id for t in merge(w if w.isascii() else w.translate(signs))])
            else:
                ids.append(None)
                other.append(i)
        for i, e in zip(other, self.encode_batch([new[i] for i in other], add_special_tokens=False)):
            ids[i] = e.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))])
        self.number.update(zip(new, range(len(self.n), len(self.n) + len(new))))
        self.first, self.n = np.concatenate([self.first, first]), np.concatenate([self.n, n])
        self.chars += sum(map(len, new))

    def narrow(self, end: int) -> str:
        """The narrowest little-endian unsigned type that holds all ids and ``end``."""
        return "<u2" if max(self.top, end) < 1 << 16 else "<u4"

    def arrays(self, texts: pa.Array, end: int, kind: str = "<u4") -> tuple[np.ndarray, pa.Array]:
        """(number of ids, ids as numbers of type ``kind``) of each text, with ``end`` after its own ids."""
        c = pc.fill_null(texts.cast(pa.string()), "")
        if not pc.any(pc.match_substring(c, "<|")).as_py():  # special strings are found before letters are lowered
            c = pc.replace_substring_regex(pc.ascii_lower(c), LETTER_AND_SIGN, "\\1 \\2")
        parts = pc.split_pattern(pc.replace_substring(c, "\n", " "), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode()
        at = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        n = self.n[at]
        before = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(self.first[at] - before[:-1], n) + np.arange(before[-1])
        starts = before[offsets - offsets[0]] + np.arange(len(offsets))  # one end id for each text before
        out = np.full(starts[-1], end, kind)
        own = np.ones(len(out), bool)
        own[starts[1:] - 1] = False
        out[own] = self.flat[place]
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((starts * out.itemsize).astype(np.int32)), pa.py_buffer(out)])
        return np.diff(starts), ids

    def sliced(self, texts: pa.Array, size: int = 8_000_000) -> Iterator[pa.Array]:
        """Runs of texts of about ``size`` bytes, a longer text by itself, to bound what is held at a time."""
        grown = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + size, "right")))
            yield texts.slice(at, to - at)
            at = to

    def ids(self, text: str | None, end: int) -> bytes:
        return self.arrays(pa.array([text], pa.string()), end)[1][0].as_py()


@lru_cache(2)
def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)
