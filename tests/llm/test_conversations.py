"""Repair of conversations against a forward search over (cost, edits)."""

import random
import zlib
from hashlib import sha256

import pytest
from llm.helpers import rows as sorted_rows

from cuespark.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, audit int"


def search(rows):
    """(cost, audit, lines) of rows (role, text, fault): the least of all ways, state by state."""
    def more(way, cost, edit, line=None):
        return (way[0] + cost, way[1] + edit, way[2] + ([line] if line else []))

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for state, way in list(out.items()):
                to = "a" if state == "u" else "u"
                role = "assistant" if to == "a" else "user"
                new = more(way, 3, "I", (role, ""))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    ways = {"": (0, "", [])}
    for role, text, fault in rows:
        found = {}

        def put(state, way):
            if state not in found or way[:2] < found[state][:2]:
                found[state] = way

        for state, way in inserted(ways).items():
            put(state, more(way, 4, "D"))
            if fault in ("blank", "duplicate"):
                continue
            t = 3 if fault else 0
            to = "a" if state == "u" else "u"
            put(to, more(way, 3 + t, "R", ({"a": "assistant", "u": "user"}[to], text)))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                put(role[:1], more(way, t, "K", (role, text)))
        ways = found
    return min((w for s, w in inserted(ways).items() if s in ("", "a")), key=lambda w: w[:2])


def expected(table):
    out = {}
    for conv_id, turn, role, text, *_ in table:
        own = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        elif d == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif d == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    report = []
    for conv_id, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in own:
            last = text.strip(" \t\n\v\f\r")[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "" if last in ".!?" else "truncated")
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        faults = [f for _, _, f in judged]
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = search(judged)
        report.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *map(faults.count, ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        ))
    return sorted(report, key=repr)


def check(spark, table, parts=3):
    made = spark.createDataFrame(table, SCHEMA).repartition(parts)
    found = conv.repair(conv.damaged(made))
    want = expected(table)
    assert sorted_rows(found.report) == want
    # the lines, in their order, hash to what the report says
    lines = {}
    for r in found.lines.orderBy("part", "pos", "nth").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert all(conv.lines_hash(lines.get(w[0], [])) == w[-1] for w in want)


def made_up(seed, sizes):
    random.seed(seed)
    table = []
    for conv_id, size in enumerate(sizes):
        turn = 0
        for _ in range(size):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = random.choice(["Yes.", "No!", "Why", "", "  \n", f"w{random.randrange(9)}?", "é"])
            table.append((conv_id, turn, role, text, 0))
            turn += random.choice([1, 1, 1, 2])
    return table


@pytest.mark.parametrize("levels", [2, 3, 64])
def test_auction_gives_the_least_cost_and_the_first_edits(levels):
    random.seed(levels)
    for size in [*range(12), 40, 150]:
        rows = [
            (random.choice(["user", "assistant", "system", "x", ""]),
             random.choice(["", "", "truncated", "duplicate", "blank"])) for _ in range(size)
        ]
        want = search([(role, "t", fault) for role, fault in rows])
        assert conv.cheapest(rows, levels) == want[:2]


@pytest.mark.parametrize("levels", [2, 3, 64])
def test_segments_are_composed(levels):
    random.seed(7 + levels)
    for count in (1, 2, 5, 30):
        parts = [
            [(random.choice(["user", "assistant", "system"]), random.choice(["", "truncated", "blank"]))
             for _ in range(random.randrange(1, 6))] for _ in range(count)
        ]
        full = [conv.block_table(p) for p in parts]
        letters = []
        for table in full:
            made = {}
            for s in range(4):
                ends = sorted((e, last) for (first, last), (_, e) in table.items() if first == s)
                made.update({(s, last): (table[s, last][0], chr(65 + i)) for i, (_, last) in enumerate(ends)})
            letters.append(made)
        cost, states = conv._states(letters, levels)
        edits = "".join(t[a, b][1] for t, a, b in zip(full, states, states[1:]))
        edits += conv.TAIL[states[-1]][0][1].replace(".", "")
        want = search([(r, "t", f) for p in parts for r, f in p])
        assert (cost, edits) == want[:2]


def test_conversations_of_all_lengths(spark):
    check(spark, made_up(3, [random.Random(1).randrange(9) for _ in range(60)] + [300, 0, 90]))


def test_a_conversation_over_many_ranges(spark):
    table = made_up(4, [5, 4000, 3, 7])
    table += [(1, 5, "user", "Same text.", 0)] * 40 + [(1, 9000 + i, "user", "Same text.", 0) for i in range(40)]
    check(spark, table, 8)


def test_odd_rows(spark):
    long = "a very long text " * 20_000
    table = [
        (None, None, None, None, 1), (None, 3, "user", "Hello.", 1), (1, None, "user", "Hi!", 1),
        (1, None, "user", "Hi!", 1), (1, -(2**62), "assistant", long, 1), (1, 5, "assistant", long + ".", 1),
        (2, 1, "", "x.", 1), (2, 1, "users", "x\x0b.", 1), (2, 1, "users", "y", 1), (3, 7, "system", "Be kind.", 1),
        (4, 2, "user", "　", 1), (4, 3, "assistant", "。", 1),
    ]
    check(spark, table)
    none = spark.createDataFrame([], SCHEMA)
    assert conv.audit(none).count() == 0


def test_conversations_named_by_text(spark):
    made = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "bot", "Yes.")],
                                 "conv_id string, turn int, role string, text string")
    (found,) = conv.repair(conv.damaged(made)).report.collect()
    assert found["conv_id"] == "x"
