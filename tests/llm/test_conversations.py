"""Repair of conversations against a plain recursion over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from timberline.llm import conversations as conv
from timberline.llm.queries import QUERIES

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def _repaired(rows, faults):
    """Cheapest edits of all, from the end; ties by letters."""

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3 and (rest := best(i, NEXT[state], inserted + 1)):
            options.append((rest[0] + 3, "I" + rest[1], (NAMES[NEXT[state]] + ":", *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, state, 0):
                options.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                first = role[:1]
                if (first == "s" and state == "") or first == NEXT[state]:
                    if rest := best(i + 1, first, 0):
                        options.append((rest[0] + more, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                if rest := best(i + 1, NEXT[state], 0):
                    name = NAMES[NEXT[state]]
                    options.append((rest[0] + 3 + more, "R" + rest[1], (f"{name}:{text}", *rest[2])))
        return min(options, default=None)

    return best(0, "", 0)


def brute(rows):
    of = defaultdict(list)
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        chance = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        of[conv_id]
        if chance == 1:
            text = ""
        if chance == 2:
            text = re.sub("[.!?]", "", text)
        if chance == 4:
            role = "user"
        of[conv_id] += [(turn, role, text)] * (0 if chance == 0 else 2 if chance == 3 else 1)
    out = {}
    for conv_id, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            letters = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else ""
            faults.append(fault or ("" if letters[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, left = _repaired(own, faults)
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return out


def found(frame):
    rows = conv.repair(conv.damaged(frame)).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_all_edits(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_conversations"](spark, sf_dir).collect()}
    assert got == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert any(r[5] for r in got.values())


def test_any_rows(spark):
    """Nulls, odd roles, ties of turn, repeats, conversations of several segments, other columns."""
    rng, rows = random.Random(3), []
    for c in [None, *range(60)]:
        for k in range(rng.choice([1, 2, 3, 5, 8, 40, 70])):
            turn = rng.choice([None, k, k, k, k, k // 2, 3 * k])
            role = rng.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"])
            text = rng.choice(["Hi.", "no end", " \t", "", None, "x!", "é?  ", f"w{k}.", f"z{k}."])
            rows += [(c, turn, role, text)] * rng.choice([1, 1, 1, 2])
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS chance", "2 AS present", "map(1, 2) AS `a.b`", "'x' AS again"
    )
    assert found(frame.repartition(5)) == brute(rows)


def test_dropped_and_empty(spark):
    gone = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][0]
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert found(frame) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(frame.limit(0)) == {}


def test_segments_change_nothing(monkeypatch):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "x"], ["a.", "b", "", "c!", "d."]
    for _ in range(60):
        rows = [(k, rng.choice(roles), f"{rng.choice(texts)}", rng.random() < 0.2) for k in range(9)]

        def outcome(size):
            monkeypatch.setattr(conv, "SEGMENT", size)
            one = conv.Repair()
            for row in rows:
                one.add(*row)
            return one.result()

        assert outcome(2) == outcome(3) == outcome(100)


def test_ties_go_by_letter():
    """Two ways of cost three: an insertion is before a change of role."""
    search = conv.Search([conv.Row("user", "a.", 0)], conv.ENDINGS, True)
    assert search.best(conv.START) == conv.Found(3, "KI")
    two = conv.Search([conv.Row("user", "a.", 0), conv.Row("user", "b.", 0)], conv.ENDINGS, True)
    assert two.best(conv.START) == conv.Found(3, "KR")


def test_places_that_lead_nowhere_end():
    assert conv.Search([conv.Row("user", "a.", 0)], (conv.SYSTEM,), False).best(conv.USER) is None


@pytest.mark.parametrize("rows", [4_000])
def test_long_conversation_in_linear_time(rows):
    import time

    rng, one, began = random.Random(4), conv.Repair(), time.time()
    for k in range(rows):
        one.add(k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"w{k}."]), False)
    result = one.result()
    assert len(result[6].replace("I", "")) == rows
    assert time.time() - began < 60
