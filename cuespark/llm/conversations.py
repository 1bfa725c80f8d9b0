"""Repair of the structure of conversations: cheapest edits by an auction for shortest paths.

A conversation's rows are the levels of a lattice whose states are the last role: nothing yet (B), a
system row (S), a user row (U), an assistant row (A).  Arcs are edits with whole costs.  The cheapest
audit is a shortest path; of several the one whose edits' initials come first in ASCII.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5, sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import batches_of
from cuespark.session import stored

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

LEVELS = 64  # levels of a lattice; longer conversations are solved in blocks of so many

B, S, U, A = range(4)
#: The state behind a user or assistant row, by the state before.
TURN = {B: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Arc = tuple[int, str, int]  # cost, edits, node


# One lattice.


def auction(arcs: list[list[Arc]], origin: int, target: int, price: list[int]) -> int:
    """The length of a shortest path, by an auction over the nodes' prices.

    arcs: by node; every node must reach the target, and every cycle cost something.  Prices begin as
    any that no arc exceeds: price[i] <= cost + price[j].  The path grows from the origin along an arc
    that its end's price allows in full; where none does, the end's price rises to the least that
    an arc offers and the path shrinks by that end.  When the target is reached, the difference of
    prices is the length, and all arcs of all shortest paths are tight.
    """
    path = [origin]
    while path[-1] != target:
        end = path[-1]
        offer, _, node = min((cost + price[j], edits, j) for cost, edits, j in arcs[end])
        if offer > price[end]:
            price[end] = offer
            if len(path) > 1:
                path.pop()
        else:
            path.append(node)
    return price[origin] - price[target]


def trace(arcs: list[list[Arc]], origin: int, target: int, price: list[int]) -> tuple[str, list[int]]:
    """The first in ASCII of the paths over tight arcs: its edits and nodes.

    Edits of the arcs of one node are no beginnings of each other, so the first arc from which tight
    arcs lead to the target is right.
    """
    dead: set[int] = set()
    path, edits = [origin], [""]
    choices = [_tight(arcs, origin, price)]
    while path[-1] != target:
        for letters, node in choices[-1]:
            if node not in dead:
                path.append(node)
                edits.append(letters)
                choices.append(_tight(arcs, node, price))
                break
        else:
            dead.add(path.pop())
            edits.pop()
            choices.pop()
    return "".join(edits), path


def _tight(arcs: list[list[Arc]], node: int, price: list[int]) -> Iterator[tuple[str, int]]:
    own = price[node]
    return iter(sorted((e, j) for cost, e, j in arcs[node] if cost + price[j] == own))


def reaching(arcs: list[list[Arc]], target: int) -> set[int]:
    """The nodes with a way to the target."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, own in enumerate(arcs):
        for _, _, j in own:
            back[j].append(i)
    found, open_ = {target}, [target]
    while open_:
        for i in back[open_.pop()]:
            if i not in found:
                found.add(i)
                open_.append(i)
    return found


class Lattice:
    """Levels of four states; arcs go to the next level, or stay (insertions)."""

    def __init__(self, steps: list[list[list[Arc]]]):
        """steps: per level and state the arcs, whose nodes are states of the next level; an arc whose
        edits are a single I stays on its level.
        """
        self.depth = len(steps)
        self.arcs: list[list[Arc]] = [[] for _ in range(4 * self.depth + 4)]
        least = [0] * (self.depth + 1)
        for level in range(self.depth - 1, -1, -1):
            onward = []
            for state, own in enumerate(steps[level]):
                for cost, edits, to in own:
                    stays = edits == "I" and cost == INSERT
                    self.arcs[4 * level + state].append((cost, edits, 4 * (level + (not stays)) + to))
                    if not stays:
                        onward.append(cost)
            least[level] = least[level + 1] + min(onward, default=0)
        # what no path can avoid on the levels ahead is a price that no arc exceeds
        self.price = [p for p in least for _ in range(4)]

    def paths(self, origins: list[int], ends: list[int]) -> dict[tuple[int, int], tuple[int, str, list[int]]]:
        """(state, last state) -> (cost, edits, states by level) of the cheapest paths that exist."""
        out = {}
        for last in ends:
            target = 4 * self.depth + last
            alive = reaching(self.arcs, target)
            arcs = [[a for a in own if a[2] in alive] for own in self.arcs]
            price = self.price.copy()
            for first in origins:
                if first in alive:
                    cost = auction(arcs, first, target, price)
                    edits, nodes = trace(arcs, first, target, price)
                    out[first, last] = (cost, edits, nodes)
        return out


# Rows: (role, fault); fault is "", "blank", "duplicate" or "truncated".


def row_arcs(role: str, fault: str) -> list[list[Arc]]:
    """The edits of one row, by state; insertions before it stay on the level."""
    out: list[list[Arc]] = []
    for state in range(4):
        own = [(DELETE, "D", state)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            own.append((REROLE + more, "R", TURN[state]))
            kept = {"s": S if state == B else None, "u": U, "a": A}.get(role[:1])
            if kept is not None and (kept == S or TURN[state] == kept):
                own.append((KEEP + more, "K", kept))
        own.append((INSERT, "I", TURN[state]))
        out.append(own)
    return out


#: Behind the last row: what is still inserted, by state; one target.
TAIL: list[list[Arc]] = [[(0, "", B)], [(2 * INSERT, "II", B)], [(INSERT, "I.", B)], [(0, "", B)]]


def block_table(rows: list[tuple[str, str]], levels: int = LEVELS) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state behind) -> (cost, edits) of rows (role, fault), the last edit being a row's."""
    every = [B, S, U, A]
    if len(rows) <= levels:
        found = Lattice([row_arcs(*row) for row in rows]).paths(every, every)
        return {k: v[:2] for k, v in found.items()}
    size = levels
    while size * levels < len(rows):
        size *= levels
    parts = [block_table(rows[i : i + size], levels) for i in range(0, len(rows), size)]
    found = Lattice([table_arcs(p) for p in parts]).paths(every, every)
    return {k: v[:2] for k, v in found.items()}


def table_arcs(table: dict[tuple[int, int], tuple[int, str]]) -> list[list[Arc]]:
    return [
        [(cost, edits, last) for (first, last), (cost, edits) in table.items() if first == state]
        for state in range(4)
    ]


def cheapest(rows: list[tuple[str, str]], levels: int = LEVELS) -> tuple[int, str]:
    """Cost and audit of a whole conversation of rows (role, fault)."""
    if len(rows) < levels:
        steps = [row_arcs(*row) for row in rows]
    else:
        steps = [table_arcs(block_table(rows, levels))]
    cost, edits, _ = Lattice([*steps, TAIL]).paths([B], [B])[B, B]
    return cost, edits.replace(".", "")


def fault_of(text: str, again: bool) -> str:
    """A row's first fault; again: its role and text were seen earlier."""
    last = text.rstrip(BLANKS)[-1:]
    if not last:
        return "blank"
    if again:
        return "duplicate"
    return "" if last in ".!?" else "truncated"


def repaired(rows: list[tuple[str, str]], audit: str, state: int = B) -> list[tuple[str, str]]:
    """The (role, text) that an audit leaves of rows (role, text), from a state on."""
    out, own = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = TURN[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(own)
        if edit == "K":
            state = {"s": S, "u": U, "a": A}[role[:1]]
            out.append((role, text))
        elif edit == "R":
            state = TURN[state]
            out.append((ROLE[state], text))
    return out


def lines_hash(lines: list[tuple[str, str]]) -> str:
    return sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# Tables.


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) after seeded damage, with `live` false for a row dropped.

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes the
    signs .!? from it, 3 repeats the row, 4 makes its role user.  NULL reads as one space, also in the
    hashed text; conv_id and turn stay NULL.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    d = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(d == 1, "").when(d == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), (d != 0).alias("live"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, lines array<struct<role:string,text:string>>"
)
OPEN = "turn long, role string, text string, live boolean, again boolean, key binary"


def _report(rows: list[tuple]) -> tuple:
    """REPORT of a conversation's rows (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [(role, text) for _, role, text in rows]
    cost, audit = cheapest([(role, fault) for (role, _), fault in zip(pairs, faults)])
    lines = repaired(pairs, audit)
    return (
        gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        illegal_pairs([role[:1] for role, _ in pairs]), cost, audit, lines_hash(lines),
        [{"role": r, "text": t} for r, t in lines],
    )


def _solve(kind: str, id_type: pa.DataType):
    """A task's range of rows, in order: reports of the conversations inside it, and the rows of its
    first and last conversation, which may go on in other ranges.
    """
    report = pa.schema([
        ("conv_id", id_type), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()),
        ("role", pa.string()), ("text", pa.string()), ("live", pa.bool_()), ("again", pa.bool_()),
        ("key", pa.binary()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
        ("lines", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ])

    def rows_of(batches):
        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "live")
            yield from zip(*(batch.column(n).to_pylist() for n in names))

    def open_rows(part, conv_id, rows):
        seen: set[bytes] = set()
        for pos, (_, turn, role, text, live) in enumerate(rows):
            key, again = None, False
            if live and text.rstrip(BLANKS):
                key = md5(f"{len(role)}:{role}{text}".encode()).digest()
                again = key in seen
                seen.add(key)
            yield (conv_id, part, pos, turn, role, text, live, again, key, *[None] * 9)

    def solve(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def made():
            held = None  # a conversation that may be the last
            first = True
            for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
                if first:
                    first = False
                    yield from open_rows(part, conv_id, rows)
                    continue
                if held is not None:
                    own = [r[1:4] for r in held[1] if r[4]]
                    yield (held[0], part, 0, *[None] * 6, *_report(own))
                held = (conv_id, list(rows))
            if held is not None:
                yield from open_rows(part, *held)

        yield from batches_of(made(), report, 2_000)

    fields = f"conv_id {kind}, part int, pos long, {OPEN}, {REPORT}"
    return solve, fields


class Repair:
    """What repair gives: `report`, a row per conversation, and `lines`, the repaired rows."""

    def __init__(self, report: DataFrame, lines: DataFrame):
        self.report, self.lines = report, lines


def repair(rows: DataFrame) -> Repair:
    """Repair conversations given as rows (conv_id, turn, role, text, live).

    Rows that are not live only make their conversation known.  A conversation's rows are taken by
    turn, missing turns first; equal turns by role, the first 40 characters and a hash of the text.
    report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256);
    lines: (conv_id, part, pos, nth, role, text), ordered by part, pos and nth.

    Rows are dealt by ranges of this order, so that a conversation may hold any share of them.  Those
    inside a range are solved there.  The rows of a range's first and last conversation are kept; a
    conversation's rows in one range are a segment, whose costs between all pairs of states are
    found alone; segments are then the levels of a further lattice.

    NULL role and text must have been replaced; NULL conv_id is a conversation, too; repeated rows are
    duplicates; very long texts are only hashed and searched; an empty table gives no rows; other
    columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    if kind != "bigint":
        rows, kind = rows.withColumn("conv_id", F.col("conv_id").cast("string")), "string"
    order = ["conv_id", "turn", "role", "head", "tie", "uid"]
    dealt = (
        rows.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "live",
            F.substring("text", 1, 40).alias("head"), F.xxhash64("text").alias("tie"),
            F.monotonically_increasing_id().alias("uid"),
        )
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", "live")
    )
    solve, fields = _solve(kind, id_type)
    solved = stored(dealt.mapInArrow(solve, fields), "conversations")
    columns = [f.split()[0] for f in REPORT.split(", ")[:8]]
    inside = solved.filter(F.col("audit").isNotNull())
    rest = _open(solved.filter(F.col("audit").isNull()), kind, id_type)
    lines = inside.select(
        "conv_id", "part", "pos", F.posexplode("lines").alias("nth", "line")
    ).select("conv_id", "part", "pos", F.col("nth").cast("long").alias("nth"), "line.role", "line.text")
    return Repair(
        inside.select("conv_id", *columns).unionByName(rest.report.select("conv_id", *columns)),
        lines.unionByName(rest.lines),
    )


def _open(rows: DataFrame, kind: str, id_type: pa.DataType) -> Repair:
    """Repair of conversations whose rows lie in several ranges; at most two begin or end in each."""
    # an earlier range may hold the row that a segment's first of its kind repeats; one row per
    # segment and text is compared
    firsts = rows.filter("key IS NOT NULL AND NOT again").select("conv_id", "part", "pos", "key")
    earliest = firsts.groupBy("conv_id", "key").agg(
        F.min("part").alias("least"), F.count("*").alias("n")
    ).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "least")
    repeats = firsts.join(
        earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    ).filter("part > least").select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("pos").alias("q")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
        & (F.col("pos") == F.col("q"))
    )
    marked = stored(
        rows.join(repeats, same, "left").select(
            "conv_id", "part", "pos", "turn", "role", "text", "live",
            (F.col("again") | F.col("p").isNotNull()).alias("again"),
        ),
        "conversations-open",
    )

    names = ["conv_id", "part", "blank", "duplicate", "truncated", "illegal", "initial", "final",
             "turns", "low", "high", "first", "last", "cost", "place", "edits"]
    kinds = [id_type, pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3,
             pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]

    def live_rows(table: pa.Table) -> list[tuple]:
        table = table.sort_by("pos")
        columns = ("turn", "role", "text", "live", "again")
        every = zip(*(table[c].to_pylist() for c in columns))
        return [(t, r, x, again) for t, r, x, live, again in every if live]

    def segment(table: pa.Table) -> pa.Table:
        """A segment's numbers, repeated for each pair of states that its rows can lead between."""
        own = live_rows(table)
        faults = [fault_of(x, again) for _, _, x, again in own]
        initials = [r[:1] for _, r, _, _ in own]
        turns = sorted({t for t, _, _, _ in own if t is not None})
        if own:
            found = block_table([(r, f) for (_, r, _, _), f in zip(own, faults)])
        else:
            found = {(s, s): (0, "") for s in range(4)}
        # where the edits of a pair stand among those from the same state, in ASCII
        places = {}
        for state in range(4):
            ends = sorted((e, last) for (first, last), (_, e) in found.items() if first == state)
            places.update({(state, last): i for i, (_, last) in enumerate(ends)})
        head = (
            table["conv_id"][0].as_py(), table["part"][0].as_py(),
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs(initials),
            initials[0] if own else None, initials[-1] if own else None, len(turns),
            turns[0] if turns else None, turns[-1] if turns else None,
        )
        lines = [(*head, *k, cost, places[k], edits) for k, (cost, edits) in found.items()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], names=names)

    fields = (
        f"conv_id {kind}, part int, blank long, duplicate long, truncated long, illegal long, "
        "initial string, final string, turns long, low long, high long, first int, last int, cost long, "
        "place int, edits string"
    )
    segments = stored(
        marked.groupBy("conv_id", "part").applyInArrow(segment, fields), "conversations-segments"
    )

    out_names = ["conv_id", "part", "first", "last", "gaps", "blank", "duplicate", "truncated", "illegal",
                 "cost", "tail"]

    def compose(table: pa.Table) -> pa.Table:
        """The states between a conversation's segments, with its numbers on the first of them."""
        by_part: dict[int, list[dict]] = {}
        for r in table.sort_by("part").to_pylist():
            by_part.setdefault(r["part"], []).append(r)
        parts = list(by_part)
        heads = [by_part[p][0] for p in parts]
        # the place of a pair's edits stands for them: places sort as edits do
        tables = [
            {(r["first"], r["last"]): (r["cost"], chr(65 + r["place"])) for r in by_part[p]} for p in parts
        ]
        cost, states = _states(tables)
        live = [h for h in heads if h["initial"] is not None]
        illegal = sum(h["illegal"] for h in live)
        illegal += sum(a["final"] + b["initial"] not in LEGAL for a, b in zip(live, live[1:]))
        turned = [h for h in live if h["turns"]]
        distinct = sum(h["turns"] for h in turned)
        distinct -= sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
        gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
        tail = TAIL[states[-1]][0][1].replace(".", "")
        lines = [
            (heads[0]["conv_id"], part, states[i], states[i + 1],
             *((gaps, *(sum(h[f] for h in heads) for f in ("blank", "duplicate", "truncated")), illegal,
                cost) if i == 0 else (None,) * 6), tail if i == len(parts) - 1 else "")
            for i, part in enumerate(parts)
        ]
        made = [id_type, pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*lines), made)], names=out_names)

    chosen = segments.drop("edits").groupBy("conv_id").applyInArrow(
        compose,
        f"conv_id {kind}, part int, first int, last int, gaps long, blank long, duplicate long, "
        "truncated long, illegal long, cost long, tail string",
    )
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    edits = segments.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("first").alias("f"),
        F.col("last").alias("l"), "edits",
    )
    path = stored(
        chosen.join(
            edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
            & (F.col("first") == F.col("f")) & (F.col("last") == F.col("l")),
        ).select("conv_id", "part", "first", *numbers, F.concat("edits", "tail").alias("edits")),
        "conversations-path",
    )
    audits = path.groupBy("conv_id").agg(
        *(F.max(n).alias(n) for n in numbers),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "edits"))), lambda x: x["edits"]), ""
        ).alias("audit"),
    )

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        conv_id, part = (k.as_py() for k in key)
        own = [(r, x) for _, r, x, _ in live_rows(left)]
        state, audit = right["first"][0].as_py(), right["edits"][0].as_py()
        lines = repaired(own, audit, state)
        n = len(lines)
        return pa.table({
            "conv_id": pa.array([conv_id] * n, id_type), "part": pa.array([part] * n, pa.int32()),
            "pos": pa.array([0] * n, pa.int64()), "nth": pa.array(range(n), pa.int64()),
            "role": pa.array([r for r, _ in lines], pa.string()),
            "text": pa.array([x for _, x in lines], pa.string()),
        })

    lines = stored(
        marked.groupBy("conv_id", "part").cogroup(path.groupBy("conv_id", "part")).applyInArrow(
            apply, f"conv_id {kind}, part int, pos long, nth long, role string, text string"
        ),
        "conversations-lines",
    )

    def hashes(batches):
        """The hash of each conversation's lines, which come in order."""
        at, own = None, None

        def every():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        def made():
            nonlocal at, own
            for conv_id, role, text in every():
                if own is None or conv_id != at:
                    if own is not None:
                        yield at, own.hexdigest()
                    at, own = conv_id, sha256()
                else:
                    own.update(b"\n")
                own.update(f"{role}:{text}".encode())
            if own is not None:
                yield at, own.hexdigest()

        yield from batches_of(made(), pa.schema([("c", id_type), ("repaired_sha256", pa.string())]))

    hashed = (
        lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
        .select("conv_id", "role", "text").mapInArrow(hashes, f"c {kind}, repaired_sha256 string")
    )
    report = audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest()))
    )
    return Repair(report, lines)


def _states(tables: list[dict], levels: int = LEVELS) -> tuple[int, list[int]]:
    """The cheapest way through tables of segments, then the tail: cost and the state at each border.

    Tables hold one letter per arc, which sorts as the arc's edits do.  Many tables are taken together
    in groups, whose own letters then give the way inside each.
    """
    if len(tables) < levels:
        lattice = Lattice([*(table_arcs(t) for t in tables), TAIL])
        cost, _, nodes = lattice.paths([B], [B])[B, B]
        return cost, [n % 4 for n in nodes[:-1]]
    size = math.ceil(len(tables) / (levels - 1))
    groups = [tables[i : i + size] for i in range(0, len(tables), size)]
    inner = [Lattice([table_arcs(t) for t in g]).paths([B, S, U, A], [B, S, U, A]) for g in groups]
    outer = []
    for found in inner:
        made = {}
        for state in range(4):
            ends = sorted((v[1], last) for (first, last), v in found.items() if first == state)
            for i, (_, last) in enumerate(ends):
                made[state, last] = (found[state, last][0], chr(65 + i))
        outer.append(made)
    cost, borders = _states(outer, levels)
    out = [borders[0]]
    for found, first, last in zip(inner, borders, borders[1:]):
        out += [n % 4 for n in found[first, last][2]][1:]
    return cost, out


def audit(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, ..., audit, repaired_sha256) of conversations (conv_id, turn, role, text) after
    `damaged`; see there and `repair` for odd rows.
    """
    return repair(damaged(conversations)).report
