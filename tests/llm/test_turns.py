import hashlib
import heapq
import random
import zlib

import pytest

import __spark_entry__ as entry
from loomlog.llm import turns

SF = "/root/testdata/sf0.001"
DDL = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
SPACE = " \t\n\x0b\f\r"


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))


def cheapest(faults):
    """(cost, edits, roles made) by uniform-cost search over (rows done, grammar state)."""
    heap, done = [(0, "", 0, "^", ())], set()
    follow = {"^": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    while heap:
        cost, edits, at, state, made = heapq.heappop(heap)
        if at == len(faults) and state in "^a":
            return cost, edits, made
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if role[0] in follow[state]:
                heapq.heappush(heap, (cost + 2, edits + "I", at, role[0], (*made, (None, role))))
        if at == len(faults):
            continue
        role, fault = faults[at]
        heapq.heappush(heap, (cost + 3, edits + "D", at + 1, state, made))
        if fault in ("blank", "duplicate"):
            continue
        short = int(fault == "truncated")
        if role[:1] and role[0] in follow[state]:
            heapq.heappush(heap, (cost + short, edits + "K", at + 1, role[0], (*made, (at, role))))
        for new in ("user", "assistant"):
            if new[0] in follow[state]:
                heapq.heappush(heap, (cost + 2 + short, edits + "R", at + 1, new[0], (*made, (at, new))))


def brute(rows, ids):
    """The operator's rows for ``rows`` after damage."""
    out = []
    for conv in ids:
        own = in_order([r for r in rows if r[0] == conv])
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, kind))
        at = [r[1] for r in own if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faults, faults[1:], strict=False)]
        cost, audit, made = cheapest(faults)
        lines = [f"{role}:{'' if i is None else own[i][3]}" for i, role in made]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        kinds = [[f for _, f in faults].count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *kinds, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def random_rows(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randrange(longest + 1)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut", " \n", "", None, f"t{turn}.", f"t{turn}", "end. \t"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


@pytest.fixture(params=[turns.BLOCK, 3, 1])
def block(request, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", request.param)


def test_damage_and_repair_equal_brute_force(spark, block):
    rows = random_rows(1, 120, 14) + [(None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, DDL)
    got = turns.repair(turns.damaged(frame), frame, "times").collect()
    assert ordered(got) == ordered(brute(spoiled(rows), {r[0] for r in rows}))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op11_turn_repair"](spark, SF).collect()
    assert ordered(got) == ordered(brute(spoiled(rows), {r[0] for r in rows}))


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in random_rows(2, 40, 9)]
    frame = spark.createDataFrame(rows, DDL)
    lines = {}
    for r in turns.repaired_rows(frame).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in turns.repair(frame).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_one_long_conversation_and_a_common_one(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 64)
    rng = random.Random(3)
    rows = [(0, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}", "same.", "x" * 5000 + "."])) for t in range(900)]
    rows += [(c, t, role, text) for c in range(1, 200) for t, (role, text) in enumerate([("user", "hi."), ("assistant", "ho."), ("user", "cut")])]
    got = turns.repair(spark.createDataFrame(rows, DDL)).collect()
    assert ordered(got) == ordered(brute(rows, range(200)))


def test_suffixes_are_made_once():
    signatures = ["FJFJ", "AFJFJ", "BFJFJ", "FJFJFJ"]
    automaton, made = turns.Automaton(), []
    for marks in sorted(signatures, key=lambda m: m[::-1]):
        made += [node for node in automaton.enter("", marks) if not any(node is old for old in made)]
    assert len(made) == 1 + len({m[i:] for m in signatures for i in range(len(m))})


def test_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "assistant", "a."), (1, 0, "user", "b."), (2, None, "user", "q?"), (2, None, "assistant", "r.")]
    frame = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], DDL + ", times STRING, marks STRING, block INT")
    assert ordered(turns.repair(frame).collect()) == ordered(brute(rows, {1, 2}))
    assert turns.repair(spark.createDataFrame([], DDL)).count() == 0
    gone = turns.repair(frame.filter("conv_id = 1"), frame).filter("conv_id = 2").first()
    assert tuple(gone) == (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
