"""Packing token streams into windows of fixed token proportions by deficit round-robin over source queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialworks.llm.tokens import word_ids
from trialworks.operators.prefix import sum_before
from trialworks.storage import written

PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def serve_window(space: int, deficits: dict, share: dict, waiting: dict) -> list[tuple]:
    """Grant ``space`` tokens to the sources that wait: [(source, tokens)], changing the deficits.

    Each source earns its share of the window and is served up to what it is owed. What remains, because queues have
    run dry, goes to the sources that still wait, by their shares; they then owe it, and the dry ones keep their claim.
    """
    for s in share:
        deficits[s] += share[s] * space
    left, grants = space, []
    owed = {s: min(max(int(deficits[s]), 0), waiting[s]) for s in sorted(waiting) if waiting[s] > 0}
    while left > 0 and owed:
        for s, n in owed.items():
            n = min(n, left)
            if n > 0:
                grants.append((s, n))
                deficits[s] -= n
                waiting[s] -= n
                left -= n
        open_ = [s for s in owed if waiting[s] > 0]
        total = sum(share[s] for s in open_)
        owed = {s: min(waiting[s], max(1, int(left * share[s] / total) if total > 0 else left)) for s in open_}
    return grants


def tail_lengths(n: int) -> list[int]:
    """The last sequence's tokens as powers of two, largest first, so that nothing is padded."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, window_sequences: int = 16,
    lane_bytes: int = 6_000_000, shares: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    order: tuple[str, str] | None = None, slot_bytes: int = 16_384,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document's ids.

    Rows are dealt by a hash of their id and text to lanes of about ``lane_bytes``; a lane holds a queue per source.
    Windows of ``window_sequences`` sequences lie on one line over all lanes; each is filled to the target ``shares``
    (default: each source's share of all tokens) by deficit round-robin, and a lane starts with the deficits that the
    lanes before it leave, found from token sums per lane and source. A lane that runs out passes its last window on
    to the next. Sequences are full; the last one is cut into powers of two.

    With ``order``, two columns of whole numbers (slot, place in it), lanes are runs of slots instead, as many as hold
    ``lane_bytes`` at ``slot_bytes`` a slot, and a source's queue is in that order, so the line of windows follows it;
    without, a queue is in the order of ids. Ties are broken by length and ids, so a lane made again is the same.

    Ids travel as 16-bit numbers where the vocabulary has no larger one, and are widened for ``ids_crc32``.

    Null texts count as empty (their only id is the end id), null sources as one source, rows with a null or repeated
    id are packed as documents of their own; an empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        *[(F.col(c) if order else F.lit(0)).cast("long").alias(n) for n, c in zip(("slot", "at"), order or ("", ""))],
    )
    if order:
        base = base.withColumn("lane", F.floor(F.col("slot") / max(1, lane_bytes // slot_bytes)))
    else:
        size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        lanes = max(1, -(-size // lane_bytes))
        base = base.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lanes)))

    def tokenise(batches):
        import pyarrow as pa

        words, names = word_ids(tokenizer_path), ["doc_id", "source", "lane", "slot", "at"]
        for b in batches:
            at = 0
            for texts in words.sliced(b.column("text")):
                n, ids = words.arrays(texts, end_id, words.narrow(end_id))
                part = b.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(n, pa.int64()), ids], [*names, "n", "ids"])

    # Texts are tokenised once; the sums read only the small columns of that table.
    tokens = written(base.mapInArrow(tokenise, "doc_id long, source string, lane long, slot long, at long, n long, ids binary"), "tokens", "zstd")
    heads = _lane_heads(tokens.groupBy("lane", "source").agg(F.sum("n").alias("n")), shares)

    def pack_lane(key, rows, head):
        import zlib

        import numpy as np
        import pandas as pd

        if not len(rows):
            return pd.DataFrame(columns=["doc_id", *PIECE.names])
        first, total = int(head["first"].iloc[0]), int(head["total"].iloc[0])
        share = dict(zip(head["source"], head["share"]))
        deficits = {s: share[s] * first - n for s, n in zip(head["source"], head["served"])}
        rows = rows.sort_values(["source", "slot", "at", "doc_id", "n", "ids"], kind="stable", na_position="last")
        queues = {s: q for s, q in rows.groupby("source", sort=True)}
        queues = {s: [list(zip(q["doc_id"].tolist(), q["ids"], q["n"].tolist())), 0, 0] for s, q in queues.items()}
        waiting = {s: sum(d[2] for d in q[0]) for s, q in queues.items()}
        at, out, window = first, [], length * window_sequences
        whole = total - total % length  # where the cut tail begins
        bounds, tail = [], whole
        for n in tail_lengths(total - whole):
            tail += n
            bounds.append((tail - n, tail))
        while any(waiting.values()):
            space = min(window - at % window, sum(waiting.values()))
            for s, n in serve_window(space, deficits, share, waiting):
                queue = queues[s]
                while n:
                    doc, ids, size = queue[0][queue[1]]
                    if at < whole:
                        seq, offset, room = at // length, at % length, length - at % length
                    else:
                        i = next(i for i, (a, b) in enumerate(bounds) if a <= at < b)
                        seq, offset, room = whole // length + i, at - bounds[i][0], bounds[i][1] - at
                    take = min(n, size - queue[2], room)
                    width = len(ids) // size  # bytes of an id
                    piece = np.frombuffer(ids, f"<u{width}", take, width * queue[2]).astype("<u4")
                    out.append((doc, queue[2], take, zlib.crc32(piece), size, seq, offset))
                    queue[2] += take
                    at += take
                    n -= take
                    if queue[2] == size:
                        queue[1], queue[2] = queue[1] + 1, 0
        return pd.DataFrame(out, columns=["doc_id", *PIECE.names]).astype({"doc_id": "Int64"})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *PIECE.fields])
    return tokens.groupBy("lane").cogroup(heads.groupBy("lane")).applyInPandas(pack_lane, schema)


def _lane_heads(sums: DataFrame, shares: dict[str, float] | None) -> DataFrame:
    """For each lane and each source in it: the lane's first place on the line of all windows, the tokens of the source
    that earlier lanes serve, and its target share. ``sums`` (lane, source, n) is a small row per lane and source."""
    sums = written(sums, "lane-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    firsts = sum_before(sums.groupBy("lane").agg(F.sum("n").alias("n")), [], "lane", "n", "first").select("lane", "first")
    if shares:
        items = [x for s, w in shares.items() for x in (F.lit(s), F.lit(float(w)))]
        weight = sums.select("source").distinct().withColumn("share", F.coalesce(F.create_map(*items)[F.col("source")], F.lit(0.0)))
    else:
        weight = sums.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
    out = sum_before(sums, ["source"], "lane", "n", "served").join(firsts, "lane").join(weight, "source")
    return out.select("lane", "source", "first", F.lit(total).cast("long").alias("total"), "served", "share")
