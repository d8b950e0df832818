"""Repair of conversation structure at least cost: turns are kept, given another role, deleted or inserted by branch-and-bound."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialworks.storage import written

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated turn adds where it is not deleted.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the role order s?(ua)+ by its last turn: none yet, system, user, assistant. A conversation may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant turn, whichever is due, leads to.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")


def after(state: int, initial: str) -> int | None:
    """The state after a kept turn; None where its role is not due."""
    if initial == "s":
        return SYSTEM if state == START else None
    return DUE[state] if initial == ROLE[DUE[state]][0] else None


def suffix_bounds(turns: list[tuple], start: bool) -> list[int]:
    """Least cost of the turns from each place on, whatever the edits before: turns alone, or two by two where their roles
    cannot follow one another and so one of them changes or something is inserted between. A system turn is free at the start."""
    keep = [DELETE if forced else min(DELETE, (0 if x in "ua" and x or x == "s" and start else REROLE) + (TRUNCATED if cut else 0)) for forced, cut, x in turns]
    out = [0] * (len(turns) + 2)
    for i in range(len(turns) - 1, -1, -1):
        out[i] = keep[i] + out[i + 1]
        if i + 1 < len(turns):
            (f1, c1, x1), (f2, c2, x2) = turns[i : i + 2]
            if not f1 and not f2 and x1 + x2 not in LEGAL:
                both = min(DELETE + keep[i + 1], keep[i] + DELETE, TRUNCATED * (c1 + c2) + min(INSERT, REROLE))
                out[i] = max(out[i], both + out[i + 2])
    return out


def cheapest(turns: list[tuple], entry: int) -> list[tuple[int, str] | None]:
    """(cost, audit) of the best edits of ``turns``, (must go, truncated, role initial) each, from a state to each state.

    Depth first with an explicit stack, the cheapest edit first. A node is a place and a state; its table holds the best
    prefix (cost, then audit) that led there, and worse ones go no further. A prefix also ends where its cost and the bound of
    what follows exceed the incumbents of all states that it can still reach. Two prefixes of a node with one cost differ in
    a letter before either ends, so the lesser one is lesser with any suffix.
    """
    n, bounds = len(turns), (suffix_bounds(turns, False), suffix_bounds(turns, True))
    best: list[tuple[int, str] | None] = [None] * 4
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        known = table[i][state]
        if known is not None and known <= (cost, audit):
            continue
        if state >= USER:
            low = cost + bounds[0][i]
            if best[USER] and best[ASSISTANT] and low > best[USER][0] and low > best[ASSISTANT][0]:
                continue
        table[i][state] = (cost, audit)
        if i == n:
            best[state] = (cost, audit)
        due = DUE[state]
        more = [(cost + INSERT, "I", i, due)]
        if i < n:
            forced, cut, initial = turns[i]
            more.append((cost + DELETE, "D", i + 1, state))
            if not forced:
                extra = cost + (TRUNCATED if cut else 0)
                more.append((extra + REROLE, "R", i + 1, due))
                kept = after(state, initial)
                if kept is not None:
                    more.append((extra, "K", i + 1, kept))
        more.sort(reverse=True)
        stack += [(j, s, c, audit + letter) for c, letter, j, s in more]
    return best


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 removes
    its ends of sentences, 3 repeats it, 4 gives it the role user. A null part of the key, role or text counts as a space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(say(conv_id), F.lit(":"), say(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), say(role).alias("role"), say(text).alias("text"), fault.alias("fault"))
    text_ = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def faults(rows: DataFrame, parts: int = 64) -> DataFrame:
    """conv_id, turn, role, hash, n, blank, truncated, again: rows that are equal in all four are one, which occurs ``n`` times.

    ``again``: an earlier turn of the conversation has its role and text. Only hashes are moved. A text that one conversation
    repeats at very many turns is joined back in ``parts`` places.
    """
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = rows.select("conv_id", "turn", "role", _hash(F.col("text")).alias("hash"), (bare == "").alias("blank"), ((bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    slim = slim.groupBy("conv_id", "turn", "role", "hash").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    slim = written(slim.withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(parts)).cast("int")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    first = slim.groupBy("conv_id", "role", "hash").agg(F.min(order).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    spots = slim.select("conv_id", "role", "hash", "part").distinct().alias("s").join(first.alias("f"), same("s", "f", "conv_id", "role", "hash")).select("s.*", "f.first")
    out = slim.alias("t").join(spots.alias("s"), same("t", "s", "conv_id", "role", "hash", "part"), "left")
    again = F.col("s.first").isNotNull() & ~F.col("s.first.turn").eqNullSafe(F.col("t.turn"))
    return out.select("t.conv_id", "t.turn", "t.role", "t.hash", "t.n", "t.blank", "t.truncated", again.alias("again"))


SEGMENT = "conv_id {id}, seq long, entry int, state int, cost long, audit string, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, low {turn}, high {turn}, first_turn {turn}, last_turn {turn}, turns long"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _segments(most: int):
    """Solves runs of at most ``most`` turns of a conversation, as they come sorted; one row for each way through a run."""

    def solve(conv, seq, run, first):
        turns, initials, numbers = [t for t, _, _ in run], [x for _, _, x in run], [n for _, n, _ in run]
        kinds = [0, 0, 0]
        for kind, _, _ in run:
            if kind[3] is not None:
                kinds[kind[3]] += 1
        known = [x for x in numbers if x is not None]
        head = dict(conv_id=conv, seq=seq, blank=kinds[0], duplicate=kinds[1], truncated=kinds[2], illegal=sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), first_initial=initials[0], last_initial=initials[-1],
                    low=min(known, default=None), high=max(known, default=None), first_turn=numbers[0], last_turn=numbers[-1], turns=len(set(known)))
        for entry in (START,) if first else range(4):
            for state, found in enumerate(cheapest([t[:3] for t in turns], entry)):
                if found:
                    yield head | dict(entry=entry, state=state, cost=found[0], audit=found[1])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seq, conv, held, first, any_yet, out, schema = TaskContext.get().partitionId() << 40, None, [], False, False, [], None
        for b in batches:
            if schema is None:
                kind = {"{id}": b.schema.field("conv_id").type, "{turn}": b.schema.field("turn").type, "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
                schema = pa.schema([(x.split()[0], kind[x.split()[1]]) for x in SEGMENT.split(", ")])
            for r in b.to_pylist():
                if not any_yet or r["conv_id"] != conv:
                    if held:
                        out += solve(conv, seq, held, first)
                        seq, held = seq + 1, []
                    conv, first, any_yet = r["conv_id"], any_yet, True  # a partition may begin inside a conversation
                for copy in range(r["n"]):
                    if len(held) == most:
                        out += solve(conv, seq, held, first)
                        seq, held, first = seq + 1, [], False
                    kind = 0 if r["blank"] else 1 if r["again"] or copy else 2 if r["truncated"] else None
                    held.append(((kind in (0, 1), kind == 2, r["role"][:1], kind), r["turn"], r["role"][:1]))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if held:
            out += solve(conv, seq, held, first)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class Join:
    """Segments of one conversation, in order: the best prefix to each state meets the best ways on."""

    def __init__(self):
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}
        self.next: dict[int, tuple[int, str]] = {}
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.last, self.seq, self.begun = 0, None, None, (None, None), None, False

    def add(self, r: dict) -> None:
        if r["seq"] != self.seq:
            self.step()
            self.seq = r["seq"]
            for k in self.n:
                self.n[k] += r[k]
            initial, turn = self.last
            if self.begun:
                self.n["illegal"] += initial + r["first_initial"] not in LEGAL
            self.turns += r["turns"] - (self.begun and turn is not None and turn == r["first_turn"])
            self.low = min((x for x in (self.low, r["low"]) if x is not None), default=None)
            self.high = max((x for x in (self.high, r["high"]) if x is not None), default=None)
            self.last, self.begun = (r["last_initial"], r["last_turn"]), True
        if r["entry"] in self.best:
            cost, audit = self.best[r["entry"]]
            found = (cost + r["cost"], audit + r["audit"])
            if r["state"] not in self.next or found < self.next[r["state"]]:
                self.next[r["state"]] = found

    def step(self) -> None:
        if self.seq is not None:
            self.best, self.next = self.next, {}

    def report(self) -> dict:
        self.step()
        cost, audit = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.n | dict(gaps=gaps, cost=cost, audit=audit)


def _reports(batches):
    import pyarrow as pa

    def out(rows, kind):
        names = [("conv_id", kind), *((k, pa.int64()) for k in REPORT), ("audit", pa.string())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(names))

    rows, conv, own, kind = [], None, None, None
    for b in batches:
        kind = b.schema.field("conv_id").type
        for r in b.to_pylist():
            if own is None or r["conv_id"] != conv:
                if own:
                    rows.append({"conv_id": conv} | own.report())
                    if len(rows) >= 2000:
                        yield out(rows, kind)
                        rows = []
                conv, own = r["conv_id"], Join()
            own.add(r)
    if own:
        rows.append({"conv_id": conv} | own.report())
    if rows:
        yield out(rows, kind)


class Editor:
    """Follows an audit along the turns of a conversation and keeps the hash of what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> dict:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1
        return {"at": self.lines - 1, "role": role, "text": text}

    def _due(self, text: str) -> dict:
        self.state = DUE[self.state]
        return self._line(ROLE[self.state], text)

    def inserts(self) -> list[dict]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out.append(self._due(""))
        return out

    def turn(self, role: str, text: str) -> list[dict]:
        out = self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            out.append(self._due(text))
        elif edit == "K":
            self.state = after(self.state, role[:1])
            out.append(self._line(role, text))
        return out


def _edited(turns: bool):
    def run(batches):
        import pyarrow as pa

        conv, editor, report, rows, schema = None, None, None, [], None

        def close():
            left = editor.inserts()
            return ([{"conv_id": conv} | x for x in left] if turns else []) + [{"conv_id": conv, "audit": editor.audit, "repaired_sha256": editor.sha.hexdigest()} | {k: report[k] or 0 for k in REPORT}]

        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), *((k, pa.int64()) for k in REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for r in b.to_pylist():
                if editor is None or r["conv_id"] != conv:
                    if editor:
                        rows += close()
                    conv, editor, report = r["conv_id"], Editor(r["audit"] or ""), r
                if r["kind"] == 1:
                    editor = Editor(r["audit"])
                    report = r
                elif r["kind"] == 2:
                    made = editor.turn(r["role"], r["text"])
                    rows += [{"conv_id": conv} | x for x in made] if turns else []
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if editor:
            rows += close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def repair(rows: DataFrame, ids: DataFrame | None = None, segment: int = 64, turns: bool = True) -> DataFrame:
    """Least-cost repair of conversations (conv_id, turn, role, text) to the role order ``s?(ua)+`` or none at all.

    A conversation's rows are taken by turn (nulls first; of one turn by role, then by a hash of the text). A row's first
    fault counts: blank, duplicate (role and text seen before), truncated (its end is not ``.``, ``!`` or ``?``). Keeping
    costs 0, giving another role 3, inserting an empty turn 3, deleting 4; blank and duplicate rows must go, truncated ones
    add 3 unless they go. The audit has the edits' initials in order, of equal cost the ASCII-least.

    Returns two kinds of rows: the repaired turns (conv_id, at from 0, role, text), if ``turns``, and per conversation one
    with null ``at``: gaps, blank, duplicate, truncated, illegal (adjacent role initials not su, ua or au), cost, audit and
    the hash of the repaired ``role:text`` lines. ``ids`` (conv_id) adds conversations without rows.

    Rows are dealt by ranges of their order, so a conversation with very many turns is solved in many tasks, ``segment``
    turns at a time from each state that may come before, and the segments' best ways are joined in order. Its repaired text
    is hashed as a stream, in one task since the hash is sequential, which holds a row at a time. Its audit, a character
    a turn, is one value.

    Null roles and texts count as one space, whose role is never due; a null conv_id is a conversation of its own; texts of
    any length count whole; an empty table gives the ``ids`` alone. Other columns are ignored.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kinds = dict(rows.dtypes)
    order = ["conv_id", "turn", "role", "hash"]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ways = written(dealt.mapInArrow(_segments(segment), SEGMENT.format(id=kinds["conv_id"], turn=kinds["turn"])), "segments")
    report = f"conv_id {kinds['conv_id']}, {', '.join(f'{k} long' for k in REPORT)}, audit string"
    reports = ways.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq", "entry", "state").mapInArrow(_reports, report)
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    told = [(k, "long") for k in REPORT]
    found = reports.select("conv_id", F.lit(1).alias("kind"), *none(("turn", kinds["turn"]), ("role", "string"), ("hash", "string"), ("text", "string")), *REPORT, "audit")
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", _hash(F.col("text")).alias("hash"), "text", *none(*told, ("audit", "string")))
    both = found.unionByName(texts)
    if ids is not None:
        own = ids.select(F.col("conv_id").cast(kinds["conv_id"]).alias("conv_id")).distinct()
        both = both.unionByName(own.select("conv_id", F.lit(0).alias("kind"), *none(("turn", kinds["turn"]), ("role", "string"), ("hash", "string"), ("text", "string"), *told, ("audit", "string"))))
    out = f"conv_id {kinds['conv_id']}, at long, role string, text string, {', '.join(f'{k} long' for k in REPORT)}, audit string, repaired_sha256 string"
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "hash").mapInArrow(_edited(turns), out)


def repair_report(rows: DataFrame, ids: DataFrame | None = None, segment: int = 64) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``ids`` or ``rows``."""
    found = repair(rows, ids, segment, turns=False)
    return found.where(F.col("at").isNull()).select("conv_id", *REPORT, "audit", "repaired_sha256")
