"""Exact n-gram Jaccard self-join of documents, as classes and components.

Texts of equal shingle sets form a class. A shingle's id is the first 48 bits of its hash; its global place is
(how many documents have it, id), rare ones first, and one number of 64 bits holds both.

1. Counting. Each task cuts its texts into slabs of about two million shingles and sends each slab's (shingle, member) pairs,
   packed and sorted, to the task that has that range of shingles. A shingle that occurs often in one slab goes there once, with its count.
   The answer to each slab is the global place of those of its shingles that other documents, too, have. Nothing
   that occurs once can be in an intersection, so sets keep these alone, and a class goes whose kept shingles are
   fewer than its size times the threshold.
2. Prefix index: two sets of Jaccard J >= t share a shingle among the first |s| - ceil(t |s|) + 1 of each in the
   global order. Of these only the kept ones are sent.
3. Each shingle's entries are cut into chains of like sizes, and a chain is called by its least class: its
   hub. All chains of one hub make one group, so that the many shingles which near copies share send
   each of them to few groups. Very common shingles are salted by class; their chains give one interval of sizes per
   salt, and touching intervals of a shingle become one chain again.
4. Within a group, the sets stand in a prefix tree in the global order, read from its common end, where like sets share
   their path: nodes hold up to 32 shingles, and a set that begins like others goes down the same nodes. Each member
   probes it level by level: overlaps are kept per node and shared by all sets below, and a subtree is left once overlap
   plus remaining length can't reach the bound. Sets known to be in the probe's component are skipped, as a link to
   them can't change the result.
5. A group of more than ``block`` members is cut into blocks. First each block is compared with itself and with
   block 0. Then the members outside of the group's largest component so far, if any, are compared with all of its members in pairs of blocks.
   So no pair is left out, and a large group of copies costs two readings of each.
6. The links of all groups give the components.

Cases. A null text, or one without words, has size 0, is linked with nothing and is its own component
(texts with fewer words than a shingle: the whole sequence is the one shingle). A very long text is a slab alone. Rows with one
document id are one document. A null id sorts first and comes back null. An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_key, materialize, shuffle_parts
from .components import components
from .hashing import mix, shingle_sets, slices

ID_BITS = 48
#: Ranges of shingles per partition, handled one after the other.
RANGES = 4
#: Most members of a slab, as their numbers have 16 bits.
SLAB_MEMBERS = 60_000
DOC = np.dtype([("key", "<i8"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8")])
MEMBER = np.dtype([("n", "<i8"), ("c", "<u8")])
COUNT = np.dtype([("t", "<u8"), ("n", "<u8")])
ENTRY = np.dtype([("t", "<u8"), ("c", "<u8"), ("n", "<u4")])
#: Flag in an entry's size: the shingle is salted. No text has so many shingles.
SALTED = 1 << 31
FLUSH = 1_000_000
MOVED = "part int, place long, kind string, slab long, blob binary"
KEPT = "kind string, key long, n long, a long, b long, c long, part int, entries binary, shingles binary"


class Limits(NamedTuple):
    """Sizes of the pieces that the work is cut into; no result depends on them."""

    slab: int = 2_000_000  #: shingles of a slab
    hot: int = 64  #: a shingle of so many members of a slab goes to its counter once
    salt: int = 20_000  #: entries of a shingle that go to one partition, about
    block: int = 256  #: members of a group that are compared in one go


def zeros(n: int) -> pa.Array:
    return pa.array(np.zeros(n, np.int64))


def i64(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.uint64).view(np.int64))


def sets_of(batch: pa.RecordBatch, k: int):
    """(keys, sets) of slices of a batch of (key, text)."""
    keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    for lo, hi in slices(texts):
        part = [(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(lo, hi - lo).to_pylist()]
        yield keys[lo:hi], shingle_sets(part, k)


def class_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum()), int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum())


def packed(t: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending ids as differences of 32 bits where these suffice, and columns of other numbers."""
    gaps = np.diff(t)
    short = not len(gaps) or int(gaps.max()) < 1 << 32
    body = struct.pack("<IBQ", len(t), short, int(t[0])) + gaps.astype("<u4").tobytes() if short else struct.pack("<IBQ", len(t), short, 0) + t.astype("<u8").tobytes()
    return b"".join([body, *(c.tobytes() for c in columns)])


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, short, first = struct.unpack_from("<IBQ", blob)
    at = 13
    if short:
        t = np.cumsum(np.concatenate((np.array([first], np.uint64), np.frombuffer(blob, "<u4", n - 1, at).astype(np.uint64))), dtype=np.uint64)
        at += 4 * (n - 1)
    else:
        t = np.frombuffer(blob, "<u8", n, at)
        at += 8 * n
    out = [t]
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def frequency_code(n: np.ndarray) -> np.ndarray:
    """Numbers of documents as 0 to 255 in the same order: exact below 128, then four steps for each doubling."""
    n = np.asarray(n, np.float64)
    return np.where(n < 128, n, np.minimum(255, 128 + np.floor(4 * np.log2(np.maximum(n, 128) / 128)))).astype(np.uint64)


def frequency(code: np.ndarray) -> np.ndarray:
    code = np.asarray(code, np.float64)
    return np.where(code < 128, code, 128 * 2 ** ((code - 127) / 4))


def moved(part, place, kind: str, slab, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    full = lambda x: np.broadcast_to(np.asarray(x, np.int64), n)
    return pa.RecordBatch.from_arrays([pa.array(full(part).astype(np.int32)), pa.array(full(place)), pa.array([kind] * n, pa.string()), pa.array(full(slab)), pa.array(blobs, pa.binary())], ["part", "place", "kind", "slab", "blob"])


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))


def range_of(t: np.ndarray, ranges: int) -> np.ndarray:
    return ((t >> np.uint64(ID_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def slabs(docs: DataFrame, k: int, parts: int, limits: Limits) -> DataFrame:
    """Documents (key, text) to rows of MOVED: a slab's pairs by range, and what its own task needs of it later."""
    ranges = parts * RANGES

    def go(batches):
        slab, seen = TaskContext.get().partitionId() << 32, set()
        rows, members, held, size = [], [], [], 0

        def flush():
            home = slab % 0x7FFFFFFF % parts
            yield moved(home, -1, "docs", slab, [np.array(rows, DOC).tobytes()])
            if not held:
                return
            t = np.concatenate(held)
            local = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            at = np.argsort(t, kind="stable")
            t, local = t[at], local[at]
            cuts = cuts_of(t)
            count = np.diff(cuts)
            hot = count >= limits.hot
            often = np.repeat(hot, count)
            own = [("members", np.array(members, MEMBER).tobytes())]
            if hot.any():
                own.append(("hot", packed(t[often], local[often])))
                ids, n = t[cuts[:-1]][hot], count[hot]
                which = range_of(ids, ranges)
                edge = cuts_of(which)
                yield moved(which[edge[:-1]] // RANGES, which[edge[:-1]], "counts", slab, [packed(ids[a:b], n[a:b].astype("<u4")) for a, b in zip(edge, edge[1:], strict=False)])
            for kind, blob in own:
                yield moved(home, -1, kind, slab, [blob])
            t, local = t[~often], local[~often]
            if len(t):
                which = range_of(t, ranges)
                edge = cuts_of(which)
                yield moved(which[edge[:-1]] // RANGES, which[edge[:-1]], "pairs", slab, [packed(t[a:b], local[a:b]) for a, b in zip(edge, edge[1:], strict=False)])

        for batch in batches:
            for keys, sets in sets_of(batch, k):
                for key, s in zip(keys.tolist(), sets, strict=True):
                    a, b = class_hash(s)
                    c = int(mix(np.array([a], np.uint64) ^ mix(np.array([b], np.uint64)))[0])
                    rows.append((key, len(s), a, b, c))
                    if len(s) and (a, b) not in seen:
                        seen.add((a, b))
                        held.append(s >> np.uint64(64 - ID_BITS))
                        members.append((len(s), c))
                        size += len(s)
                    if size >= limits.slab or len(held) >= SLAB_MEMBERS or len(rows) >= 16 * SLAB_MEMBERS:
                        yield from flush()
                        slab += 1
                        rows, members, held, size = [], [], [], 0
        if rows:
            yield from flush()

    return docs.mapInArrow(go, MOVED)


def by_value(batches, name: str):
    """(value, rows) of runs of one value of a column, across batches; rows are (kind, slab, blob)."""
    now, rows = None, []
    for b in batches:
        at = b.column(b.schema.get_field_index(name)).to_numpy()
        kind, slab, blob = (b.column(b.schema.get_field_index(c)) for c in ("kind", "slab", "blob"))
        cuts = cuts_of(at)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if now is not None and at[lo] != now:
                yield now, rows
                rows = []
            now = at[lo]
            rows += zip(kind.slice(lo, hi - lo).to_pylist(), slab.slice(lo, hi - lo).to_pylist(), blob.slice(lo, hi - lo).to_pylist(), strict=True)
    if rows:
        yield now, rows


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by range to answers by slab: (place of the shingle in the global order, member) of shingles of several documents."""

    def go(batches):
        for place, got in by_value(batches, "place"):
            if place < 0:
                for kind, slab, blob in got:
                    yield moved(slab % 0x7FFFFFFF % parts, 0, kind, slab, [blob])
                continue
            parts_of = [(kind, slab, unpacked(blob, "<u2" if kind == "pairs" else "<u4")) for kind, slab, blob in got]
            t = np.concatenate([x[0] for _, _, x in parts_of])
            weight = np.concatenate([np.ones(len(x[0]), np.int64) if kind == "pairs" else x[1].astype(np.int64) for kind, _, x in parts_of])
            at = np.argsort(t, kind="stable")
            cuts = cuts_of(t[at])
            total = np.add.reduceat(weight[at], cuts[:-1])
            n = np.empty(len(t), np.int64)
            n[at] = np.repeat(total, np.diff(cuts))
            del at, weight
            lo = 0
            for kind, slab, x in parts_of:
                mine = n[lo : lo + len(x[0])]
                lo += len(x[0])
                keep = mine > 1
                if keep.any():
                    code = frequency_code(mine[keep]).astype(np.uint8)
                    blob = packed(x[0][keep], code, x[1][keep]) if kind == "pairs" else packed(x[0][keep], code)
                    yield moved(slab % 0x7FFFFFFF % parts, 0, kind, slab, [blob])

    return rows.repartitionById(parts, "part").sortWithinPartitions("place").mapInArrow(go, MOVED)


def kept_rows(kind: str, count: int, **columns) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "n": pa.int64(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "part": pa.int32(), "entries": pa.binary(), "shingles": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([kind] * count, pa.string()), *(columns[c] if c in columns else pa.nulls(count, t) for c, t in kinds.items())], ["kind", *kinds])


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def kept(answers: DataFrame, num: int, den: int, parts: int, limits: Limits) -> DataFrame:
    """Answers by slab to rows of KEPT: documents, prefix entries packed by target partition, and the kept sets."""

    def go(batches):
        held, size = [], 0

        def flush():
            e = np.concatenate(held)
            e = e[np.argsort(e["p"], kind="stable")]
            cuts = cuts_of(e["p"])
            plain = np.empty(len(e), ENTRY)
            for f in ENTRY.names:
                plain[f] = e[f]
            return kept_rows("entries", len(cuts) - 1, part=pa.array(e["p"][cuts[:-1]].astype(np.int32)), entries=pa.array([plain[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))

        for _, got in by_value(batches, "slab"):
            members, g, local, hot, codes = None, [], [], [], []
            for kind, _, blob in got:
                if kind == "docs":
                    d = np.frombuffer(blob, DOC)
                    yield kept_rows("doc", len(d), key=pa.array(d["key"]), n=pa.array(d["n"]), a=i64(d["a"]), b=i64(d["b"]), c=i64(d["c"]))
                elif kind == "members":
                    members = np.frombuffer(blob, MEMBER)
                elif kind == "hot":
                    hot = unpacked(blob, "<u2")
                elif kind == "counts":
                    codes.append(unpacked(blob, "u1"))
                else:
                    t, code, member = unpacked(blob, "u1", "<u2")
                    g.append(code.astype(np.uint64) << np.uint64(ID_BITS) | t)
                    local.append(member)
            if members is None:
                continue
            if len(hot):
                t, code = (np.concatenate(x) for x in zip(*codes, strict=True))
                order = np.argsort(t)
                t, code = t[order], code[order]
                g.append(code[np.searchsorted(t, hot[0])].astype(np.uint64) << np.uint64(ID_BITS) | hot[0])
                local.append(hot[1])
            if not g:
                continue
            g, local = np.concatenate(g), np.concatenate(local)
            shared = np.bincount(local, minlength=len(members))
            stay = shared * den >= members["n"] * num
            mine = stay[local]
            g, local = g[mine], local[mine]
            if not len(g):
                continue
            at = np.lexsort((g, local))
            g, local = g[at], local[at].astype(np.int64)
            cuts = cuts_of(local)
            who, count = local[cuts[:-1]], np.diff(cuts)
            yield kept_rows("set", len(who), n=pa.array(members["n"][who]), c=i64(members["c"][who]), shingles=pa.array([g[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
            # those that no other document has come first in the order: they fill the prefix before the kept ones
            take = prefix_length(members["n"][who], num, den) - (members["n"][who] - count)
            first = np.arange(len(g)) - np.repeat(cuts[:-1], count) < np.repeat(take, count)
            g, local = g[first], local[first]
            e = np.empty(len(g), np.dtype([*ENTRY.descr, ("p", "<i4")]))
            e["t"], e["c"], e["n"] = g, members["c"][local], members["n"][local]
            with np.errstate(over="ignore"):
                salts = np.maximum(1, np.ceil(frequency(g >> np.uint64(ID_BITS)) / limits.salt)).astype(np.uint64)
                e["n"] |= np.where(salts > 1, SALTED, 0).astype(np.uint32)
                e["p"] = mix(g + mix(e["c"]) % salts) % np.uint64(parts)
            held.append(e)
            size += len(e)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return answers.repartitionById(parts, "part").sortWithinPartitions("slab").mapInArrow(go, KEPT)


def chains(index: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(h, m): classes m of the groups called by hubs h, the hub itself included."""

    def go(batches):
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        e = np.frombuffer(b"".join(blobs), ENTRY)
        del blobs
        e = e[np.lexsort((e["c"], e["n"], e["t"]))]
        e = e[np.concatenate(([True], (e["t"][1:] != e["t"][:-1]) | (e["c"][1:] != e["c"][:-1])))]
        n = (e["n"] & np.uint32(SALTED - 1)).astype(np.int64)
        start = np.concatenate(([True], (e["t"][1:] != e["t"][:-1]) | (n[1:] * num > n[:-1] * den)))
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        hub, count, salted = np.minimum.reduceat(e["c"], first), np.bincount(run), e["n"][first] >= SALTED
        keep = ((count > 1) & ~salted)[run]
        pair = np.unique(np.stack((hub[run][keep], e["c"][keep]), axis=1), axis=0)
        # a chain of one salt is named by shingle and hub, as a class has one salt of a shingle
        name, keep, last = mix(e["t"][first] ^ mix(hub)), salted[run], np.append(first[1:], len(e)) - 1
        spans = [x[salted] for x in (name, hub, e["t"][first], n[first], n[last], count)]
        for kind, rows in (("whole", [pair[:, 0], pair[:, 1]]), ("member", [name[run][keep], e["c"][keep]]), ("span", spans)):
            rows = [i64(x) for x in rows]
            rows += [zeros(len(rows[0]))] * (6 - len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows[0]), pa.string()), *rows], ["kind", "h", "m", "t", "lo", "hi", "n"])

    found = materialize(index.repartitionById(parts, "part").mapInArrow(go, "kind string, h long, m long, t long, lo long, hi long, n long"))
    salted = found.where("kind = 'member'").select("h", "m").join(across_salts(found.where("kind = 'span'"), num, den), "h")
    return found.where("kind = 'whole'").select("h", "m").unionByName(salted.select(F.col("hub").alias("h"), "m")).distinct()


def across_salts(spans: DataFrame, num: int, den: int) -> DataFrame:
    """(h, hub): for each salt's chain h its hub over all salts, from the chains' intervals of sizes (h, m, t, lo, hi, n).
    Intervals that overlap or follow within the ratio are one chain of the shingle; chains of one class go."""
    sign = F.lit(-(2**63))  # classes are ordered as unsigned numbers
    by = Window.partitionBy("t").orderBy("lo", "hi", "h")
    far = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("lo") * num <= far * den, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("t", "run")
    runs = runs.select("h", F.min(F.col("m").bitwiseXOR(sign)).over(whole).bitwiseXOR(sign).alias("hub"), F.sum("n").over(whole).alias("classes"))
    return runs.where("classes > 1").select("h", "hub").distinct()


class PrefixTree:
    """Sets in the global order, its common end first, as a tree whose nodes hold up to 32 shingles in a row."""

    STEP = 32

    def __init__(self, sets: list[np.ndarray], universe: np.ndarray):
        """Sets that begin alike lie side by side once sorted, so a node is a run of equal parts."""
        codes = [np.searchsorted(universe, s)[::-1] for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: codes[i].astype(">i4").tobytes()))
        codes = [codes[i] for i in self.order]
        self.size = np.array([len(x) for x in codes])
        self.levels, node = [], np.zeros(len(sets), np.int64)
        for d in range(0, int(self.size.max()), self.STEP):
            live = np.flatnonzero(self.size > d)
            part = np.full((len(live), self.STEP), len(universe), np.int64)
            for i, k in enumerate(live):
                x = codes[k][d : d + self.STEP]
                part[i, : len(x)] = x
            new = np.ones(len(live), bool)
            new[1:] = (node[live][1:] != node[live][:-1]) | (part[1:] != part[:-1]).any(axis=1)
            first, at = np.flatnonzero(new), np.cumsum(new) - 1
            longest = np.maximum.reduceat(self.size[live], first)
            ends = self.size[live] <= d + self.STEP
            self.levels.append((node[live][first], part[first], longest, live[ends], at[ends]))
            node[live] = at

    def overlaps(self, mark: np.ndarray, need: np.ndarray, wanted: np.ndarray, least: int) -> np.ndarray:
        """Whether each set's overlap with the probe reaches its bound. mark: the probe's shingles in
        the universe, and false after the end; wanted: sets to decide; least: the least of their bounds."""
        out = np.zeros(len(self.size), bool)
        over = np.zeros(1, np.int64)
        for d, (parent, codes, longest, leaf, at) in enumerate(self.levels):
            now = np.full(len(parent), -1, np.int64)
            live = np.flatnonzero(over[parent] >= 0)
            now[live] = over[parent[live]] + mark[codes[live]].sum(axis=1)
            now[now + np.maximum(0, longest - self.STEP * (d + 1)) < least] = -1
            ok = wanted[leaf] & (now[at] >= need[leaf])
            out[leaf[ok]] = True
            over = now
            if not (now >= 0).any():
                break
        return out


def find_links(ids: np.ndarray, size: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, group: np.ndarray, num: int, den: int, forward: bool = True) -> list[tuple[int, int]]:
    """Links between members of two blocks (flags) that join components. size: of the whole sets, sets: what is kept of
    them; group: the components known so far; forward: only pairs whose right member comes later, as blocks overlap."""
    if len(ids) < 2 or not left.any() or not right.any():
        return []
    universe = np.unique(np.concatenate(sets))
    inside = np.flatnonzero(right)
    tree = PrefixTree([sets[i] for i in inside], universe)
    inside = inside[tree.order]
    out, mark, group = [], np.zeros(len(universe) + 1, bool), np.unique(group, return_inverse=True)[1]
    for i in np.flatnonzero(left):
        n = size[i]
        wanted = (num * n <= den * size[inside]) & (num * size[inside] <= den * n) & (group[inside] != group[i])
        if forward:
            wanted &= inside > i
        if not wanted.any():
            continue
        need = -(-num * (n + size[inside]) // (num + den))
        at = np.searchsorted(universe, sets[i])
        mark[at] = True
        for k in inside[tree.overlaps(mark, need, wanted, int(need[wanted].min()))]:
            if group[k] != group[i]:
                out.append((int(ids[i]), int(ids[k])))
                group[group == group[k]] = group[i]
        mark[at] = False
    return out


def links(jobs: DataFrame, sets: DataFrame, num: int, den: int, forward: bool) -> DataFrame:
    """(u, v): links within jobs (h, i, j, c, left, right, comp), a row per member of a job."""
    parts = shuffle_parts(jobs.sparkSession)
    rows = jobs.join(sets, "c").select("h", "i", "j", "left", "right", "comp", "c", "n", "shingles")
    rows = rows.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", F.desc("left"), "right", "c")

    def go(batches):
        now, held = None, []

        def solved():
            left, right, comp, ids, size, blobs = (list(x) for x in zip(*held, strict=True))
            got = find_links(np.array(ids), np.array(size), [np.frombuffer(x, "<u8") for x in blobs], np.array(left), np.array(right), np.array(comp), num, den, forward)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["u", "v"])

        for batch in batches:
            for h, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (h, i, j):
                    if len(held) > 1:
                        yield solved()
                    now, held = (h, i, j), []
                held.append(row)
        if len(held) > 1:
            yield solved()

    return rows.mapInArrow(go, "u long, v long")


def of_group(members: DataFrame, groups: DataFrame, salts: int = 64) -> DataFrame:
    """Members (h, ...) with the columns of their group, where it is listed; dealt over salts, as a group may hold a third of all."""
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("m"), F.lit(salts)).cast("int")).join(spread, ["h", "_salt"], "left").drop("_salt")


def group_links(members: DataFrame, sets: DataFrame, num: int, den: int, limits: Limits) -> DataFrame:
    """(u, v): links that join all components of groups (h, m)."""
    at = lambda name, n: F.pmod(F.xxhash64("m", F.lit(name)), n)
    long = lambda x: F.lit(x).cast("long")
    blocks = F.ceil(F.col("size") / limits.block).cast("long")
    sizes = members.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > limits.block)
    rows = materialize(of_group(members, sizes.select("h", blocks.alias("blocks"))))
    block = at("block", F.col("blocks"))
    js = F.when(F.col("blocks").isNull(), F.array(long(0))).when(block == 0, F.sequence(long(1), F.col("blocks") - 1)).otherwise(F.array(block))
    first = rows.select("h", F.col("m").alias("c"), long(0).alias("i"), F.explode(js).alias("j"), F.coalesce(block == 0, F.lit(False)).alias("zero"), F.col("m").alias("comp"))
    # block 0 comes first in each job and is compared with itself in one of them
    first = first.select("h", "i", "j", "c", F.lit(True).alias("left"), (~F.col("zero") | (F.col("j") == 1)).alias("right"), "comp")
    found = materialize(links(first, sets, num, den, True))
    large = rows.where("blocks is not null")
    if not large.take(1):
        return found
    known = components(found)
    large = materialize(large.join(known.withColumnRenamed("id", "m"), "m", "left").withColumn("comp", F.coalesce("component", "m")).drop("component"))
    most = large.groupBy("h", "comp").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"), F.max("n").alias("n"))
    most = most.where("n < size").select("h", "most", F.ceil((F.col("size") - F.col("n")) / limits.block).cast("long").alias("rest"))
    open_ = materialize(of_group(large, most).where("most is not null"))
    of_all = open_.select("h", F.explode(F.sequence(long(0), F.col("rest") - 1)).alias("i"), block.alias("j"), F.col("m").alias("c"), F.lit(False).alias("left"), F.lit(True).alias("right"), "comp")
    of_rest = open_.where("comp != most").select("h", at("rest", F.col("rest")).alias("i"), F.explode(F.sequence(long(0), F.col("blocks") - 1)).alias("j"), F.col("m").alias("c"), F.lit(True).alias("left"), F.lit(False).alias("right"), "comp")
    return found.unionByName(materialize(links(of_all.unionByName(of_rest), sets, num, den, False)))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, limits: Limits = Limits()) -> DataFrame:
    """(key, n_shingles, component): one row per document, key and component as ``doc_key``."""
    parts = shuffle_parts(docs.sparkSession)
    docs = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    got = materialize(kept(counted(slabs(docs, k, parts, limits), parts), num, den, parts, limits))
    rows = got.where("kind = 'doc'").select("key", "n", "a", "b", "c")
    members = materialize(chains(got.where("kind = 'entries'").select("part", "entries"), num, den, parts))
    sets = got.where("kind = 'set'").join(members.select(F.col("m").alias("c")).distinct(), "c", "left_semi")
    sets = materialize(sets.groupBy("c").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    whole = components(group_links(members, sets, num, den, limits))
    classes = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("key").alias("id"), F.first("c").alias("c"), F.count("*").alias("copies"))
    linked = materialize(classes.join(whole.withColumnRenamed("id", "c"), "c"))
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    # only classes of several documents or with links need a label; it is dealt over salts, as a class may hold a third of all rows
    labels = classes.join(linked.join(least, "component").select("c", "least"), "c", "left").where("copies > 1 or least is not null")
    labels = labels.select("a", "b", "n", F.coalesce("least", "id").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    out = rows.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(labels, ["a", "b", "n", "salt"], "left")
    out = out.select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))
    return out.unionByName(rows.where("n = 0").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that are in the component of a lesser id."""
    found = jaccard_components(docs, k, num, den)
    gone = found.where("key != component").select(F.col("key").alias("_gone"))
    return docs.join(gone, doc_key() == F.col("_gone"), "left_anti")


def plain_id(name: str):
    return F.when(F.col(name) != F.lit(NULL_KEY), F.col(name))
