"""Repair of conversations, against a plain search over edits and state paths."""

import hashlib
import random
import re
import zlib

import pytest

from tillwise.llm import conversations
from tillwise.llm.conversations import END, SPREAD, _before, _levelled

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def cheapest(kinds):
    """kinds: (initial, has to go, truncated) of each row. The least (cost, audit) with its
    turns, over all edits, by state; strings are compared whole."""
    best = {"0": (0, "", ())}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for role, to in NEXT[state].items():
                    new = (cost + 2, audit + "I", (*turns, (None, role)))
                    if role != "s" and (to not in best or new < best[to]):
                        best[to] = new
        return best

    # forwards, over prefixes: the least string for a state stays least with anything behind
    for i, (initial, goes, cut) in enumerate(kinds):
        after = {}
        for state, (cost, audit, turns) in inserted(best).items():
            ways = [(state, (cost + 3, audit + "D", turns))]
            for role, to in NEXT[state].items() if not goes else ():
                if role == initial:
                    ways.append((to, (cost + cut, audit + "K", (*turns, (i, None)))))
                if role != "s":
                    ways.append((to, (cost + 2 + cut, audit + "R", (*turns, (i, role)))))
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        best = after
    best = inserted(best)
    return min((best[s] for s in ("0", "A") if s in best), key=lambda way: way[:2])


def brute(rows):
    left = {}
    for row in damage(rows):
        left.setdefault(row[0], []).append(row)
    out = []
    for conv in {row[0] for row in rows}:
        said = sorted(left.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[2], r[3])))
        turns = [r[1] for r in said if r[1] is not None]
        seen, kinds, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in said:
            solid = SOLID.findall(text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], fault in ("b", "d"), int(fault == "t")))
        cost, audit, made = cheapest(kinds)
        names = {"u": "user", "a": "assistant"}
        lines = []
        for row, role in made:
            own, text = ("", "") if row is None else said[row][2:]
            lines.append(f"{names.get(role, own)}:{text}")
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(said, said[1:])]
        out.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                counts["b"],
                counts["d"],
                counts["t"],
                sum(pair not in ("su", "ua", "au") for pair in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def made_up(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", "  \t", "Ça va?", "why\n", "so. ", None]
    rows = []
    for conv in range(convs):
        mood = rng.random()
        for turn in range(rng.randrange(most)):
            role = "user" if mood < 0.2 else rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.random()}{rng.choice(['.', '!', '', '? '])}"
            rows.append((rng.choice([conv, conv, None]) if conv == 3 else conv, turn + rng.choice([0, 0, 0, 1]) if rng.random() < 0.9 else None, role, text))
    return rows


def test_vectors_stay_within_their_bounds():
    seen, todo = set(), [*SPREAD, END]
    while todo:
        vector = todo.pop()
        if vector in seen:
            continue
        seen.add(vector)
        assert all(vector[s] <= vector[t] + SPREAD[t][s] for s in range(4) for t in range(4))
        todo += [_levelled(_before(role, state, vector))[0] for role in "sua?" for state in "-tx"]
    assert len(seen) < 50


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_equals_brute_force(spark, chunk):
    rows = made_up(5, 40, 24)
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_long_conversation_in_many_chunks(spark):
    """Runs of one role do not converge: what is cheapest depends on the end."""
    rows = [(1, k, "user", f"{k}.") for k in range(120)] + [(2, k, "tool", f"{k}") for k in range(60)] + [(3, 5, "system", "Hm.")]
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA), chunk=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_tables(spark):
    assert conversations.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, 1, "user", "x" * 300_000 + "."), (7, 2, "assistant", "Yes.")]
    more = spark.createDataFrame([(*r, "a", 3, "d") for r in rows], SCHEMA + ", key string, pos int, digest string")
    assert sorted(map(tuple, conversations.repaired(more).collect()), key=str) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")]
    turns = conversations.Repair(spark.createDataFrame(rows, SCHEMA)).turns()
    lines = [r.line for r in turns.orderBy("pos").collect() if r.line]
    assert lines == ["user:Hi.", "assistant:\nuser:Hello?", "assistant:Yes."]
