"""Conversation structure repair: the cheapest edits that give roles in order, by bidirectional Dijkstra.

A conversation's rows are blank (no sign but space and tab to return), duplicate (role and text were there before), truncated
(the last such sign is none of ``.!?``), by the first fault that holds, or sound. Edits, with their costs: Keep 0, Rerole to user or assistant 2,
Delete 3 (all that a blank or duplicate row allows), Insert a textless user or assistant turn 2; a truncated row that stays adds 1. What
stays must have role initials ``(s?(ua)+)?``. Of the cheapest edits, those whose initials in order come first in ASCII are taken.

Lattice. A node is (rows read, state); states are: nothing so far, after system, after user, after assistant. Given state and
initial the next node is fixed, so a path is its initials. A forward and a reverse heap settle nodes by cost, the cheaper first, until
the two least costs together pass the best crossing: then each node of each cheapest path is settled from one side
at least. Nodes of the forward side from which a crossing is reached at the least cost are marked back from the crossings, and one walk
takes the first initial that stays on such a path: the least of all concatenated audits, without keeping any of them.

Scale. A conversation isn't taken as small. Rows are range-partitioned by (conversation, turn, role, text); a conversation within one
partition is repaired there. Only a partition's first and last may go on elsewhere: their rows are kept apart, and each partition's run of a
conversation that is cut gives a table: from each state to each, the least cost, and the order of the audits. The tables of a
conversation, one per partition, are a lattice of their own, solved alike, which fixes the states at the cuts. Each
run is then repaired on its own. The digest of a cut conversation is taken in one sorted pass, as SHA-256 can't be split; that
holds one line at a time.

Order. By turn, null first; rows of one turn by role and text (the first 64 characters of each, then SHA-256 of both). Equal rows stand together.

Cases. Null roles and texts are one space, and so are nulls in the key that decides the damage. An empty or other role can only be
reroled or deleted. Rows with a null conversation id are one conversation. A conversation without rows has zeros, an empty audit
and the digest of the empty text. Gaps beyond 64 bits count as the greatest number of 64 bits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, materialize, shuffle_parts

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from a state, the state that a turn of either kind can make, and the roles' names.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NOTHING, ASSISTANT)
INF = float("inf")


@lru_cache(None)
def row_edges(initial: str, truncated: bool) -> tuple:
    """By state: the edits of a sound or truncated row, each (cost, letter, next state)."""
    out = []
    for s in range(4):
        can = [(3, "D", s), (2 + truncated, "R", TURN[s])]
        if (s, initial) in NEXT:
            can.append((0 + truncated, "K", NEXT[s, initial]))
        out.append(tuple(can))
    return tuple(out)


@lru_cache(None)
def gone_edges(n: int) -> tuple:
    """By state: the deletion of ``n`` rows in succession."""
    return tuple(((3 * n, "D", s),) for s in range(4))


INSERT = tuple(((2, "I", TURN[s]),) for s in range(4))


def reverse(edges: tuple) -> tuple:
    """By end: the edges that lead there, each (cost, letter, state before)."""
    return tuple(tuple((c, x, s) for s in range(4) for c, x, t in edges[s] if t == end) for end in range(4))


reversed_edges = lru_cache(None)(reverse)


def cheapest(steps: list[tuple], begin: int, ends: tuple, insert: list[bool] | None = None, back=reversed_edges) -> tuple[int, list[tuple]] | None:
    """(cost, [(letter, layer, state after)]) of the path of least cost from (0, begin) to (last layer, one of ends), of least
    letters in order; null if there is none. steps: of each layer, edges by state. insert: the layers that turns may be put in."""
    n = len(steps)
    dist = [[INF] * (4 * n + 4) for _ in "fr"]
    done = [bytearray(4 * n + 4) for _ in "fr"]
    heaps: list[list] = [[(0, 0, begin)], [(0, 0, 4 * n + e) for e in ends]]
    dist[0][begin] = 0
    for e in ends:
        dist[1][4 * n + e] = 0

    def out(v: int):
        k, s = divmod(v, 4)
        if insert is None or insert[k]:
            for c, x, t in INSERT[s]:
                yield c, x, 4 * k + t
        if k < n:
            for c, x, t in steps[k][s]:
                yield c, x, 4 * k + 4 + t

    def into(v: int):
        k, s = divmod(v, 4)
        if insert is None or insert[k]:
            for c, x, t in back(INSERT)[s]:
                yield c, x, 4 * k + t
        if k:
            for c, x, t in back(steps[k - 1])[s]:
                yield c, x, 4 * k - 4 + t

    best = INF
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, _, v = heappop(heaps[side])
        if done[side][v]:
            continue
        done[side][v] = 1
        mine, other = dist[side], dist[1 - side]
        best = min(best, d + other[v])
        for c, _, w in (into if side else out)(v):
            if d + c < mine[w]:
                mine[w] = d + c
                best = min(best, d + c + other[w])
                heappush(heaps[side], (d + c, -w // 4 if side else w // 4, w))
    if best == INF:
        return None
    ahead, after = dist
    # nodes settled from the start that lie before a crossing of a cheapest path
    marked, stack = bytearray(4 * n + 4), []
    for v in range(4 * n + 4):
        if done[0][v] and (ahead[v] + after[v] == best or any(ahead[v] + c + after[w] == best for c, _, w in out(v))):
            marked[v] = 1
            stack.append(v)
    while stack:
        v = stack.pop()
        for c, _, u in into(v):
            if done[0][u] and not marked[u] and ahead[u] + c == ahead[v]:
                marked[u] = 1
                stack.append(u)
    at, spent, path = begin, 0, []
    while not (spent == best and at >= 4 * n and at - 4 * n in ends):
        c, x, w = min((e for e in out(at) if spent + e[0] + after[e[2]] == best or marked[e[2]] and ahead[e[2]] == spent + e[0]), key=lambda e: e[1])
        path.append((x, at // 4, w % 4))
        at, spent = w, spent + c
    return int(best), path


class Run:
    """Rows of a conversation in one partition, in order."""

    def __init__(self):
        self.kinds, self.roles, self.texts = [], [], []  # kind: b, d, t or empty
        self.turns = [None, None, 0]  # first and last that isn't null, number of distinct ones

    def add(self, turn: int | None, role: str, text: str, kind: str) -> None:
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            self.turns[2] += turn != self.turns[1]
            self.turns[1] = turn
            if self.turns[0] is None:
                self.turns[0] = turn

    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    def steps(self) -> tuple[list[tuple], list[int]]:
        """Steps of the lattice, and how many rows each reads."""
        out, width, gone = [], [], 0
        for kind, initial in zip([*self.kinds, None], [*self.initials(), ""], strict=True):
            if kind in ("b", "d"):
                gone += 1
                continue
            if gone:
                out.append(gone_edges(gone))
                width.append(gone)
                gone = 0
            if kind is not None:
                out.append(row_edges(initial, kind == "t"))
                width.append(1)
        return out, width

    def inserts(self, last: bool) -> list[bool] | None:
        """Turns are put in before rows, and after the last row of the last run only, so that each has one place."""
        return None if last else [True] * len(self.steps()[0]) + [False]

    def counts(self) -> dict:
        n = {k: self.kinds.count(k) for k in "bdt"}
        i = self.initials()
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:], strict=False))
        return {"turn_0": self.turns[0], "turn_1": self.turns[1], "turns": self.turns[2], "blank": n["b"], "duplicate": n["d"], "truncated": n["t"], "illegal": pairs, "initial_0": i[0] if i else None, "initial_1": i[-1] if i else None}

    def repaired(self, begin: int, ends: tuple, last: bool) -> tuple[int, str, list[str]]:
        """(cost, audit, lines of what stays)."""
        steps, width = self.steps()
        cost, path = cheapest(steps, begin, ends, self.inserts(last))
        first = [0]
        for w in width:
            first.append(first[-1] + w)
        audit, lines = [], []
        for letter, layer, state in path:
            if letter == "D":
                audit.append("D" * width[layer])
                continue
            audit.append(letter)
            if letter == "I":
                lines.append(f"{ROLE[state]}:")
            else:
                row = first[layer]
                lines.append(f"{ROLE[state] if letter == 'R' else self.roles[row]}:{self.texts[row]}")
        return cost, "".join(audit), lines

    def table(self, last: bool) -> list[tuple]:
        """(begin, end, cost, place of the audit among those of the same begin) of each pair that can be."""
        out, steps, insert = [], self.steps()[0], self.inserts(last)
        for begin in range(4):
            found = []
            for end in ENDS if last else range(4):
                got = cheapest(steps, begin, (end,), insert)
                if got:
                    found.append(("".join(x for x, _, _ in got[1]), end, got[0]))
            out += [(begin, end, cost, place) for place, (_, end, cost) in enumerate(sorted(found))]
        return out


def gap(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else min(high - low + 1 - n, (1 << 63) - 1)


def fold(runs: list[dict]) -> list[tuple[int, int, int]]:
    """(part, begin, end) of a conversation's runs {part, table}, in order."""
    steps = []
    for r in runs:
        by = [[], [], [], []]
        for t in r["table"]:
            by[t["begin"]].append((t["cost"], t["place"], t["end"]))
        steps.append(tuple(map(tuple, by)))
    _, path = cheapest(steps, NOTHING, ENDS, [False] * (len(steps) + 1), reverse)
    out, at = [], NOTHING
    for r, (_, _, state) in zip(runs, path, strict=True):
        out.append((r["part"], at, state))
        at = state
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of conversations (conv_id, turn, role, text) after the damage that a hash of (conv_id:turn) decides; a row
    that is dropped stays with null role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_KEY)).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), luck.alias("luck"))
    role = F.when(F.col("luck") == 0, F.lit(None)).when(F.col("luck") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("luck") == 0, F.lit(None)).when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("luck") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def fault(text: Column) -> Column:
    """b, t or empty: blank, truncated or neither."""
    kept = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(kept == "", "b").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")


COUNTS = "turn_0 long, turn_1 long, turns long, blank long, duplicate long, truncated long, illegal long, initial_0 string, initial_1 string"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text; null role and text: no row) to one row per conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    n = shuffle_parts(rows.sparkSession)
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumns({"kind": fault(F.col("text")), "mark": mark, "role_1": F.left("role", F.lit(64)), "text_1": F.left("text", F.lit(64)), "at": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role_1", "text_1", "mark", "at"]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "kind", "mark")
    whole_type = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("mark", pa.binary())])
    text_type = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part int, place long, turn long, role string, text string, kind string, mark binary"

    def solve(batches):
        """Whole conversations to results; the rows of the first and the last, which may go on elsewhere, as they are."""
        part, place, first, conv, held = TaskContext.get().partitionId(), 0, True, None, []

        def keep(rows):
            nonlocal place
            for at in range(0, len(rows), 1000):
                few = rows[at : at + 1000]
                yield pa.RecordBatch.from_pylist([{"conv": conv, "part": part, "place": place + i, **dict(zip(("turn", "role", "text", "kind", "mark"), r, strict=True))} for i, r in enumerate(few)], whole_type)
                place += len(few)

        def result(rows):
            run, seen = Run(), set()
            for turn, role, text, kind, mark in rows:
                if role is not None:
                    run.add(turn, role, text, kind if kind == "b" or mark not in seen else "d")
                    seen.add(mark)
            counts = run.counts()
            cost, audit, lines = run.repaired(NOTHING, ENDS, True)
            return {"conv": conv, "gaps": gap(*run.turns), **{c: counts[c] for c in RESULT[1:5]}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

        done = []
        for b in batches:
            for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv and conv is not None:
                    if first:
                        yield from keep(held)
                    else:
                        done.append(result(held))
                    first, held = False, []
                conv = c
                held.append(row)
                if first and len(held) >= 1000:  # it may be a conversation that fills the partition
                    yield from keep(held)
                    held = []
            if done:
                yield pa.RecordBatch.from_pylist(done, whole_type)
                done = []
        yield from keep(held)

    got = materialize(placed.mapInArrow(solve, text_type))
    whole = got.where("part is null").select("conv", *RESULT, "audit", "repaired_sha256")
    edge = got.where("part is not null").select("conv", "part", "place", "turn", "role", "text", "kind", "mark")
    return whole.unionByName(cut_conversations(edge, n))


def cut_conversations(edge: DataFrame, n: int) -> DataFrame:
    """The result of rows (conv, part, place, turn, role, text, kind, mark) of conversations that may be in several parts."""
    first = edge.where("role is not null").groupBy("conv", "mark").agg(F.min(F.struct("part", "place")).alias("first"))
    edge = edge.join(first, ["conv", "mark"], "left")
    again = (F.col("kind") != "b") & (F.struct("part", "place") != F.col("first"))
    edge = materialize(edge.withColumn("kind", F.when(again, "d").otherwise(F.col("kind"))).drop("first", "mark"))
    last = edge.groupBy("conv").agg(F.max("part").alias("last"))
    edge = edge.join(last, "conv").withColumn("is_last", F.col("part") == F.col("last")).drop("last")
    dealt = lambda df: df.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "place")
    counts_type = [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in COUNTS.split(", ")]
    key_type = [("conv", pa.int64()), ("part", pa.int32())]

    def runs(batches, names):
        """(key, Run, the values of names) of each (conv, part)."""
        key, run, more = None, None, None
        for b in batches:
            columns = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv", "part", "turn", "role", "text", "kind", *names)}
            for i in range(b.num_rows):
                here = columns["conv"][i], columns["part"][i]
                if here != key:
                    if key is not None:
                        yield key, run, more
                    key, run, more = here, Run(), [columns[c][i] for c in names]
                if columns["role"][i] is not None:
                    run.add(columns["turn"][i], columns["role"][i], columns["text"][i], columns["kind"][i])
        if key is not None:
            yield key, run, more

    entry = pa.struct([(c, pa.int32()) for c in ("begin", "end")] + [("cost", pa.int64()), ("place", pa.int32())])

    def tables(batches):
        for (conv, part), run, (is_last,) in runs(batches, ["is_last"]):
            table = [dict(zip(("begin", "end", "cost", "place"), t, strict=True)) for t in run.table(is_last)]
            yield pa.RecordBatch.from_pylist([{"conv": conv, "part": part, **run.counts(), "table": table}], pa.schema([*key_type, *counts_type, ("table", pa.list_(entry))]))

    # the text isn't needed for the tables
    found = materialize(dealt(edge.withColumn("text", F.lit(""))).mapInArrow(tables, f"conv long, part int, {COUNTS}, table array<struct<begin: int, end: int, cost: long, place: int>>"))
    lists = found.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *(c.split()[0] for c in COUNTS.split(", ")), "table"))).alias("runs"))

    def folded(batches):
        sums = [("gaps", pa.int64()), *((c, pa.int64()) for c in RESULT[1:5])]
        cuts = pa.list_(pa.struct([("part", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for conv, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = {c: sum(r[c] for r in rs) for c in RESULT[1:5]}
                full = [r for r in rs if r["initial_0"] is not None]
                total["illegal"] += sum(x["initial_1"] + y["initial_0"] not in ("su", "ua", "au") for x, y in zip(full, full[1:], strict=False))
                timed = [r for r in rs if r["turn_0"] is not None]
                turns = sum(r["turns"] for r in timed) - sum(x["turn_1"] == y["turn_0"] for x, y in zip(timed, timed[1:], strict=False))
                total["gaps"] = gap(timed[0]["turn_0"], timed[-1]["turn_1"], turns) if timed else 0
                at = [dict(zip(("part", "begin", "end"), x, strict=True)) for x in fold(rs)]
                yield pa.RecordBatch.from_pylist([{"conv": conv, **total, "cuts": at}], pa.schema([("conv", pa.int64()), *sums, ("cuts", cuts)]))

    sums = "gaps long, blank long, duplicate long, truncated long, illegal long"
    plans = materialize(lists.mapInArrow(folded, f"conv long, {sums}, cuts array<struct<part: int, begin: int, end: int>>"))
    cuts = plans.select("conv", F.explode("cuts").alias("x")).select("conv", "x.*")
    piece_type = pa.schema([*key_type, ("place", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("line", pa.string())])

    def repaired(batches):
        """A row of cost and audit for each run, then its lines."""
        for (conv, part), run, (is_last, begin, end) in runs(batches, ["is_last", "begin", "end"]):
            cost, audit, lines = run.repaired(begin, (end,), is_last)
            yield pa.RecordBatch.from_pylist([{"conv": conv, "part": part, "place": -1, "cost": cost, "audit": audit}], piece_type)
            for at in range(0, len(lines), 1000):
                yield pa.RecordBatch.from_pylist([{"conv": conv, "part": part, "place": at + i, "line": x} for i, x in enumerate(lines[at : at + 1000])], piece_type)

    pieces = materialize(dealt(edge.join(cuts, ["conv", "part"])).mapInArrow(repaired, "conv long, part int, place long, cost long, audit string, line string"))
    audits = pieces.where("place < 0").groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    def digest(batches):
        conv, h = None, None
        for b in batches:
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != conv:
                    if h is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])
                    conv, h = c, hashlib.sha256(line.encode())
                else:
                    h.update(b"\n" + line.encode())
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])

    lines = pieces.where("place >= 0").repartition(n, "conv").sortWithinPartitions("conv", "part", "place").select("conv", "line")
    shas = lines.mapInArrow(digest, "conv long, repaired_sha256 string")
    out = plans.join(audits, "conv").join(shas, "conv", "left")
    return out.select("conv", *RESULT, "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def plain_conversation() -> Column:
    return F.when(F.col("conv") != F.lit(NULL_KEY), F.col("conv")).alias("conv_id")
