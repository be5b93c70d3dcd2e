"""Conversation repair against a search over all edits from the end of the conversation."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from lexmere.llm import turnrepair
from lexmere.llm.queries import QUERIES
from lexmere.llm.turnrepair import Repair, align, repaired_summaries

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string"
GOOD = re.compile(r"(s?(ua)+)?\Z")
BODY = re.compile(r"[^\x20\x09-\x0D]")


def brute_edits(turns):
    """(cost, audit) of the cheapest, then ASCII-least edits; turns: (initial, fault)."""

    @lru_cache(None)
    def rest(i, state, inserted):
        options = []
        if i == len(turns) and state in "^a":
            options.append((0, ""))
        if i < len(turns):
            initial, fault = turns[i]
            cost, audit = rest(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                allowed = {"^": "su", "s": "u", "u": "a", "a": "u"}[state]
                if initial in allowed and initial:
                    cost, audit = rest(i + 1, initial, 0)
                    options.append((cost + late, "K" + audit))
                cost, audit = rest(i + 1, "a" if state == "u" else "u", 0)
                options.append((cost + 2 + late, "R" + audit))
        if inserted < 3:
            cost, audit = rest(i, "a" if state == "u" else "u", inserted + 1)
            options.append((cost + 2, "I" + audit))
        return min(options, default=(10**6, "~"))

    return rest(0, "^", 0)


def played(turns, audit):
    """Repaired (role, text) of turns (role, text) under an audit."""
    out, at, state = [], 0, "^"
    for edit in audit:
        role, text = turns[at][:2] if edit != "I" else (None, "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = role[:1]
        else:
            state = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[state]
        out.append((role, text))
    assert at == len(turns)
    return out


def brute(rows):
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv_id, turn, role, text in rows:
        kept = convs.setdefault(conv_id, [])
        fate = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv_id, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faulty = set(), []
        for _, role, text in turns:
            last = BODY.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role[:1], fault))
        cost, audit = brute_edits(tuple(faulty))
        kept = played([t[1:] for t in turns], audit)
        assert GOOD.match("".join(r[:1] for r, _ in kept))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        count = [sum(f == k for _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv_id, gaps, *count, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repaired_summaries(df).collect()), key=repr)


def brute_from(turns, state, end):
    """Best edits of a segment between two given states, by search over both."""
    best = {}

    def step(i, state, cost, audit, inserted):
        if cost > 3 * len(turns) + 4:
            return
        if i == len(turns) and (state not in best or (cost, audit) < best[state]):
            best[state] = (cost, audit)
        if inserted < 2:
            step(i, "a" if state == "u" else "u", cost + 2, audit + "I", inserted + 1)
        if i == len(turns):
            return
        code = turns[i]
        step(i + 1, state, cost + 3, audit + "D", 0)
        if code == "-":
            return
        late, initial = code.isupper(), code.lower()
        if initial in {"^": "su", "s": "u", "u": "a", "a": "u"}[state]:
            step(i + 1, initial, cost + late, audit + "K", 0)
        step(i + 1, "a" if state == "u" else "u", cost + 2 + late, audit + "R", 0)

    step(0, state, 0, "", 0)
    return {e: best[e] for e in end if e in best}


@pytest.mark.parametrize("state", "^sua")
def test_segments_from_every_state(state):
    rng = random.Random(state)
    for _ in range(150):
        codes = "".join(rng.choice("suax-SUA") for _ in range(rng.randint(1, 4)))
        assert align(codes, state, "^sua") == brute_from(codes, state, "^sua"), (codes, state)


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 64])
def test_repair_in_segments_is_the_whole_repair(monkeypatch, segment):
    monkeypatch.setattr(turnrepair, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(150):
        n, likely = rng.randint(1, 40), rng.random()
        turns = []
        for i in range(n):
            role = ("user", "assistant")[i % 2] if rng.random() < likely else rng.choice(["system", "user", "assistant", "tool", ""])
            fault = rng.choice(["blank", "duplicate", "truncated", None, None, None, None])
            turns.append((i, role, f"t{i}", fault))
        work, rows = Repair(), []
        for t in turns:
            rows += work.add(t)
        rows += work.end()
        audit = "".join(r[1] for r in rows)
        cost, want = brute_edits(tuple((t[1][:1], t[3]) for t in turns))
        assert audit == want
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [r[5:] for r in rows if r[1] != "D"] == played([t[1:3] for t in turns], audit)


def test_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(300):
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["user", "assistant", ("user", "assistant")[turn % 2]])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice([f"Turn {turn}.", f"Why {turn}?", "half of", "", "Same.", "End! \t\x0b"])))
    for turn in range(500):  # longer than several segments
        rows.append((1000, turn, ("user", "assistant")[turn % 2] if turn % 11 else "tool", f"Text {turn}."))
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (1, 5, None, None)]
    rows += [(2, 3, "user", "same."), (2, 3, "user", "same."), (2, 3, "assistant", "ßé "), (3, 0, "", "x."), (4, -5, "user", "y" * 200_000 + "!"), (4, 7, "assistant", "\n\t ")]
    gone = next(c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped.")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert run(spark, []) == []


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_target_alignment"](spark, "/root/testdata/sf0.01")
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(rows)
