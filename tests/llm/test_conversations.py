"""Repair of conversations against shortest paths over whole edit strings."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import conversations as c
from lacuna.llm import queries

GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Dijkstra over (cost, edits, repaired turns): the first way out of the heap is the cheapest with the least edits."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, state, turns = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, edits, turns
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in GOES:
                heapq.heappush(heap, (cost + 3, edits + "I", i, GOES[state, role[0]], turns + ((role, ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for name, price, letter in [(role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")]:
                    if (state, name[:1]) in GOES:
                        heapq.heappush(heap, (cost + price + more, edits + letter, i + 1, GOES[state, name[:1]], turns + ((name, text),)))


def plain_report(rows):
    """``rows``: (turn, role, text) after damage, nulls replaced in role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    said = [(r, t) for _, r, t in rows]
    faults = plain_faults(said)
    cost, edits, turns = cheapest(said, faults)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    legal = {"su", "ua", "au"}
    illegal = sum(x[0][:1] + y[0][:1] not in legal for x, y in zip(said, said[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, sha)


letters = st.sampled_from(["system", "user", "assistant", "tool", "", " "])
said = st.tuples(letters, st.sampled_from(["a.", "b!", "c", "d?", " ", "", "e ."]))


@settings(max_examples=400, deadline=None)
@given(st.lists(said, max_size=9))
def test_crossings_give_the_least_edits(rows):
    faults = plain_faults(rows)
    cost, edits, turns = cheapest(rows, faults)
    kinds = [c.kind_of(r[:1], f) for (r, _), f in zip(rows, faults)]
    state, spent, out, made = 0, 0, "", []
    for (role, text), kind, after in zip(rows, kinds, c.crossings([c.row_element(k) for k in kinds], 0, None)):
        price, part = c.steps(kind)[state, after]
        more, reached = c.turns_after(state, part, role, text)
        assert reached == after
        state, spent, out, made = after, spent + price, out + part, made + more
    price, part = c.ENDING[state]
    assert (spent + price, out + part) == (cost, edits)
    assert tuple(made) + tuple(turns[len(made):]) == turns


def test_least_of_all_edit_strings():
    """Every string of edits of up to seven letters, tried one by one, over all conversations of three rows of few kinds."""
    kinds = [("system", "x."), ("user", "y."), ("assistant", "z"), ("user", "")]
    for rows in itertools.product(kinds, repeat=3):
        faults, best = plain_faults(rows), None
        for n in range(8):
            for edits in itertools.product("DIKR", repeat=n):
                if n - edits.count("I") != 3:
                    continue
                i, state, cost = 0, 0, 0
                for e in edits:
                    if e == "I":
                        state, cost = GOES[state, c.TURN[state]], cost + 3
                        continue
                    role, fault = rows[i][0], faults[i]
                    i += 1
                    if e == "D":
                        cost += 4
                        continue
                    name = role[0] if e == "K" else c.TURN[state]
                    if fault in ("blank", "duplicate") or (state, name) not in GOES:
                        state = None
                        break
                    state, cost = GOES[state, name], cost + 3 * (e == "R") + 3 * (fault == "truncated")
                if state in (0, 3):
                    best = min(best or (cost, "~"), (cost, "".join(edits)))
        assert cheapest(rows, faults)[:2] == best


@settings(max_examples=150, deadline=None)
@given(st.lists(said, min_size=1, max_size=12), st.integers(1, 4))
def test_joined_elements_cross_alike(rows, size):
    """Through nodes of ``size`` rows and through all rows at once: the same states."""
    faults = plain_faults(rows)
    elements = [c.row_element(c.kind_of(r[:1], f)) for (r, _), f in zip(rows, faults)]
    parts = [elements[k:k + size] for k in range(0, len(elements), size)]
    state, out = 0, []
    for part, after in zip(parts, c.crossings([c.joined(p) for p in parts], 0, None)):
        out += c.crossings(part, state, after)
        state = after
    assert out == c.crossings(elements, 0, None)


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def check(spark, folder, frame):
    frame.write.parquet(f"{folder}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    expected = {conv: plain_report(own) for conv, own in damage(rows).items()}
    found = {r.conv_id: tuple(r)[1:] for r in queries.op13(spark, str(folder)).collect()}
    assert found == expected


CASES = [
    (1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, None, "user", "u"), (2, None, "assistant", None), (None, 1, "user", "x."), (None, 1, "user", "x."),
    (None, None, None, None), (3, 5, "tool", "t!"), (3, 9, "assistant", "t?\n"), (4, 1, "user", "w" * 300_000 + "."), (4, 2, "assistant", "é　."), (4, 2, "assistant", "é　."), (5, None, None, "only."),
]
SCHEMA = "conv_id long, turn long, role string, text string, pos long, edits string, node int"


@pytest.mark.parametrize("fan", [1, 2, 12])
def test_the_query(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(c, "FAN", fan)
    rows = CASES + [(100 + k, t, ("user", "assistant", "system")[(t + k * t // 3) % 3], f"text {t % 5}{'.?!,'[t % 4]}") for k in range(12) for t in range(k * 3)]
    if fan == 2:
        rows = rows[:60]
    check(spark, tmp_path, spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], SCHEMA))


def test_no_conversations(spark, tmp_path):
    check(spark, tmp_path, spark.createDataFrame([], SCHEMA))


def test_given_table(spark, tmp_path, sf):
    check(spark, tmp_path, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet"))


def test_a_long_conversation_and_its_repaired_rows(spark):
    rows = [(7, t // 2, ("user", "assistant", "user", "system")[t % 4], f"line {t}{'.' if t % 7 else ''}") for t in range(12_000)]
    placed, edits, report = c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    cost, audit, turns = cheapest([(r, t) for _, _, r, t in sorted(rows)], plain_faults([(r, t) for _, _, r, t in sorted(rows)]))
    assert report.collect()[0]["cost"] == cost and c.audits(edits).collect()[0]["audit"] == audit
    made = c.repaired(placed, edits).orderBy("pos", "step").collect()
    assert [(r.role, r.text) for r in made] == list(turns)
