"""Chat formatting with minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant in turn, ending with the assistant.
For every turn in order the repair keeps it, merges it into the turn before (it takes that turn's role),
relabels it, or puts an empty turn before it; at the end it may add an empty assistant turn. Dynamic programming
over the automaton's states (start, system, user, assistant) picks the choices of least cost; ties go to the
choice listed first. Costs: keep 0, merge 1 (with another role: 3), relabel 2, empty turn 3.

Scale. A conversation isn't taken as small. Turns are range-partitioned by (conversation, turn); each partition's run of a
conversation gives a 4 x 4 matrix of least costs from state to state. The few matrices of a conversation (one per
partition that it spans) are folded, which fixes the states at the cuts; each run is then
repaired on its own.

Result: one row per rendered piece, in order of (conversation, turn, seq): seq 0 an empty turn put before, 1 the turn
itself, 2 the empty one at the end. ``rendered`` of all pieces in order, joined, is the conversation.

Cases. A null or unknown role is relabelled or merged; a null text is empty. A null turn number sorts first, turns with one
number by role and text. Rows with a null conversation id are one conversation. Repeated rows are turns of their
own. Very long texts stay within their turn; very long conversations are cut at partitions. An empty table gives no rows. Other columns
are not read, whatever their names. Texts are rendered as they are: a text that holds a marker (``<|end|>`` and the like) renders as that marker
would, so clean such texts before, or tokenize markers apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, materialize, shuffle_parts

STATES = ("start", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
INF = 1e18


def options(role: int | None) -> list[list[tuple]]:
    """Per state: (cost, next state, action, role of the empty turn before or None)."""
    out = []
    for s in range(4):
        can = []
        if role in NEXT[s]:
            can.append((0, role, "keep", None))
        if s:
            can.append((1 if role == s else 3, s, "merge", None))
        can += [(2, r, "relabel", None) for r in NEXT[s] if r != role]
        can += [(3, role, "keep", q) for q in NEXT[s] if role in NEXT[q]]
        out.append(can)
    return out


OPTIONS = {r: options(r) for r in (1, 2, 3, None)}

def end_cost(state: int) -> float:
    """Empty turns that close the conversation: user and assistant after system, assistant after user."""
    return {0: 6.0, 1: 6.0, 2: 3.0, 3: 0.0}[state]


def costs(roles: list, begin: int) -> tuple[list[float], list[list]]:
    """Least cost of each state after the turns, from ``begin``; and the choices that led there."""
    now, steps = [INF] * 4, []
    now[begin] = 0.0
    for r in roles:
        new, how = [INF] * 4, [None] * 4
        for s in range(4):
            if now[s] < INF:
                for cost, to, action, empty in OPTIONS[r][s]:
                    if now[s] + cost < new[to]:
                        new[to], how[to] = now[s] + cost, (s, action, empty)
        now = new
        steps.append(how)
    return now, steps


def fold(runs: list[tuple[int, list[float]]]) -> list[tuple[int, int, int, bool]]:
    """(run, begin, end, whether last) of the runs' matrices (16 numbers) in order."""
    now, back = [0.0, INF, INF, INF], []
    for _, m in runs:
        through = [[now[s] + m[4 * s + t] for s in range(4)] for t in range(4)]
        back.append([min(range(4), key=lambda s: (x[s], s)) for x in through])
        now = [min(x) for x in through]
    state = min(range(4), key=lambda s: (now[s] + end_cost(s), s))
    out = []
    for (part, _), b in zip(reversed(runs), reversed(back), strict=True):
        out.append((part, b[state], state, not out))
        state = b[state]
    return out[::-1]


def role_code(role) -> int | None:
    return STATES.index(role) if role in STATES[1:] else None


def repair(turns: list[tuple], begin: int, end: int, last: bool) -> list[tuple]:
    """turns (turn, role, text) of a run to rows (turn, seq, role, action, rendered)."""
    _, steps = costs([role_code(r) for _, r, _ in turns], begin)
    state, path = end, []
    for how in reversed(steps):
        path.append((state, *how[state]))
        state = how[state][0]
    out = []
    for (turn, _, text), (to, s, action, empty) in zip(turns, reversed(path), strict=True):
        close = CLOSE if s else ""
        if action == "merge":
            out.append((turn, 1, STATES[to], action, "\n" + (text or "")))
            continue
        if empty is not None:
            out.append((turn, 0, STATES[empty], "insert", close + OPEN.format(STATES[empty])))
            close = CLOSE
        out.append((turn, 1, STATES[to], action, close + OPEN.format(STATES[to]) + (text or "")))
    if last:
        turn, tail = turns[-1][0], []
        while end != 3:
            end = {0: 2, 1: 2, 2: 3}[end]
            tail.append(CLOSE + OPEN.format(STATES[end]))
        if tail:
            out.append((turn, 2, "assistant", "insert", "".join(tail) + CLOSE))
        else:
            out[-1] = (*out[-1][:4], out[-1][4] + CLOSE)
    return out


def runs_of(batches, names):
    """Column lists of each maximal run of equal (conv, part), across batches."""
    held = None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
        lo = 0
        while lo < b.num_rows:
            hi = lo + 1
            while hi < b.num_rows and cols[0][hi] == cols[0][lo] and cols[1][hi] == cols[1][lo]:
                hi += 1
            if held and (held[0][0], held[1][0]) == (cols[0][lo], cols[1][lo]):
                for x, c in zip(held, cols, strict=True):
                    x += c[lo:hi]
            else:
                if held:
                    yield held
                held = [c[lo:hi] for c in cols]
            lo = hi
    if held:
        yield held


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, role, action, rendered): see above."""
    n = shuffle_parts(turns.sparkSession)
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_KEY)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv", "turn", "role", "text"]
    rows = materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    dealt = lambda df: df.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", *order[1:])

    def matrices(batches):
        for conv, part, roles in runs_of(batches, ["conv", "part", "role"]):
            codes = [role_code(r) for r in roles]
            m = [x for s in range(4) for x in costs(codes, s)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([conv[0]]), pa.array([part[0]], pa.int32()), pa.array([m], pa.list_(pa.float64()))], ["conv", "part", "m"])

    runs = dealt(rows).select("conv", "part", "role").mapInArrow(matrices, "conv long, part int, m array<double>")
    runs = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("runs"))

    def folded(batches):
        for b in batches:
            out = [(c, *x) for c, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in fold([(r["part"], r["m"]) for r in rs])]
            yield pa.RecordBatch.from_pylist([dict(zip(("conv", "part", "begin", "end", "last"), x, strict=True)) for x in out], pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]))

    cuts = materialize(runs.mapInArrow(folded, "conv long, part int, begin int, end int, last boolean"))

    def repaired(batches):
        for conv, _, turn, role, text, begin, end, last in runs_of(batches, ["conv", "part", "turn", "role", "text", "begin", "end", "last"]):
            out = list(zip(*repair(list(zip(turn, role, text, strict=True)), begin[0], end[0], last[0]), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([conv[0]] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.string()) for x in out[2:])], ["conv", "turn", "seq", "role", "action", "rendered"])

    out = dealt(rows.join(cuts, ["conv", "part"])).mapInArrow(repaired, "conv long, turn long, seq int, role string, action string, rendered string")
    return out.withColumn("conv_id", F.when(F.col("conv") != F.lit(NULL_KEY), F.col("conv"))).select("conv_id", "turn", "seq", "role", "action", "rendered")
