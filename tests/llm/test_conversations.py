import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from trialworks.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, hash string, kind int, n long, part long, audit string"


def play(turns, audit):
    """Cost and role initials of an audit, or None."""
    cost, i, roles = 0, 0, ""
    for e in audit:
        due = "a" if roles[-1:] == "u" else "u"
        if e == "I":
            cost, roles = cost + 3, roles + due
            continue
        if i == len(turns):
            return None
        forced, cut, x = turns[i]
        i += 1
        if e == "D":
            cost += 4
        elif forced:
            return None
        else:
            cost, roles = cost + 3 * cut + 3 * (e == "R"), roles + (due if e == "R" else x)
    return (cost, roles) if i == len(turns) else None


def exhaustive(turns, most=3):
    found = []
    for n in range(len(turns), len(turns) + most + 1):
        for audit in itertools.product("DIKR", repeat=n):
            got = play(turns, audit)
            if got and re.fullmatch("(s?(ua)+)?", got[1]):
                found.append((got[0], "".join(audit)))
    return min(found)


def test_branch_and_bound_equals_all_edits():
    rnd = random.Random(1)
    for _ in range(250):
        turns = [(rnd.random() < 0.2, rnd.random() < 0.3, rnd.choice("suuuaaat ")) for _ in range(rnd.randrange(5))]
        best = c.cheapest([(f, cut and not f, x) for f, cut, x in turns], c.START)
        assert min(x for x in (best[c.START], best[c.ASSISTANT]) if x) == exhaustive([(f, cut and not f, x) for f, cut, x in turns])


def dynamic(turns):
    best = {c.START: (0, "")}

    def inserts(now):
        for _ in range(4):
            for s, (cost, audit) in list(now.items()):
                to = c.USER if s != c.USER else c.ASSISTANT
                now[to] = min(now.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return now

    best = inserts(best)
    for forced, cut, x in turns:
        now = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 4, "D")]
            due = c.USER if s != c.USER else c.ASSISTANT
            if not forced:
                ways.append((due, cost + 3 + 3 * cut, "R"))
                if x == "s" and s == c.START:
                    ways.append((c.SYSTEM, cost + 3 * cut, "K"))
                if x == ("u" if due == c.USER else "a"):
                    ways.append((due, cost + 3 * cut, "K"))
            for to, k, e in ways:
                now[to] = min(now.get(to, (10**9, "")), (k, audit + e))
        best = inserts(now)
    return min(best[s] for s in (c.START, c.ASSISTANT) if s in best)


def test_long_runs_are_solved_within_few_nodes():
    rnd = random.Random(2)
    for kind in ["u", "ua", "uas", "suat", "uuaa", "s"]:
        for _ in range(4):
            turns = [(f := rnd.random() < 0.15, not f and rnd.random() < 0.2, rnd.choice(kind)) for _ in range(64)]
            best = c.cheapest(turns, c.START)
            assert min(x for x in (best[c.START], best[c.ASSISTANT]) if x) == dynamic(turns)


def brute(rows, ids):
    """rows: (conv_id, turn, role, text) after the damage."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in ids:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [(k in ("blank", "duplicate"), k == "truncated", r[1][:1]) for k, r in zip(kinds, own)]
        cost, audit = dynamic(turns)
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        lines, last, i = [], "", 0
        for e in audit:
            due = "assistant" if last == "u" else "user"
            if e != "I":
                _, role, text = own[i]
                i += 1
            if e != "D":
                lines.append((role if e == "K" else due) + ":" + ("" if e == "I" else text))
                last = lines[-1][0]
        out.append((str(conv), gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row, row] if k == 3 else [row]
    return out


def got(df):
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def conversations(seed):
    rnd = random.Random(seed)
    says = ["Hi.", "Yes!", "no", "  ", "", "é?\n", "Why? \t", "one\ntwo.", None, "a" * 5000 + "."]
    role = lambda t: rnd.choice(["user", "assistant", "user" if t % 2 == 0 else "assistant", "system" if t == 0 else "user", "tool", "", None])
    rows = []
    for conv in [*range(80), None]:
        for t in range(rnd.randrange(9)):
            rows.append((conv, rnd.choice([t, t, t + rnd.randrange(3), None]), role(t), rnd.choice(says) if rnd.random() < 0.6 else f"Unlike {rnd.random()}."))
    rows += [(1000, t, ["user", "assistant"][t % 2] if rnd.random() < 0.8 else role(t), rnd.choice(says) if rnd.random() < 0.3 else f"This is {t}.") for t in range(700)]
    rows += [(1001, t, "user", "Same text.") for t in range(150)] + [(1002, 5, "assistant", "Same row.")] * 100
    return rows


@pytest.mark.parametrize("seed,segment", [(1, 64), (2, 7)])
def test_equals_brute_force(spark, seed, segment):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA).repartition(5)
    ids = {r[0] for r in rows}
    assert got(c.repair_report(c.damaged(df), df.select("conv_id"), segment)) == brute(broken(rows), ids)


def test_damage_equals_its_rule(spark):
    rows = conversations(3)
    found = c.damaged(spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, broken(rows)))


def test_turns_and_empty_tables(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hello."), (1, 3, "user", "Go on"), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = c.repair(df).where("at is not null").orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.role, r.text) for r in made] == [(1, "system", "Be good."), (1, "user", ""), (1, "assistant", "Hello.")]
    none = df.where("conv_id < 0")
    assert c.repair_report(none).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert got(c.repair_report(none, df.select("conv_id"))) == [(i, 0, 0, 0, 0, 0, 0, "", empty) for i in "12"]
