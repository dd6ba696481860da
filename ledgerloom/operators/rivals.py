"""Transfers that share a reference, in ledger order, each taking its matched ledger row from the later ones.

What one takes decides what the next can take, so a reference's transfers are a sequence. Its rows come as one sorted stream: its bank rows, its
invoices, which are kept as arrays of numbers, and its transfers. These are scored many at once, as if no row were taken; that choice stands unless an earlier
transfer has taken the very row, as the fold ends with the same row when others are left out. Only then is a transfer looked at by itself. A transfer whose bank row
reaches 85 looks at no invoice and takes none, so bank rows are settled first. Names are compared once for many references.
Memory: the numbers of one reference's ledger rows, and PAIRS scores.
"""

from __future__ import annotations

from collections import OrderedDict
from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the transfers whose likenesses are kept, and characters of a name in one number.
KEPT, WORD = 64, 63
#: Names of either kind whose likenesses to each other are kept for the next references.
SHARED = 1024
#: Scores in memory at once, of at least one transfer.
PAIRS = 1 << 18
ROW = [("l_seq", pa.int64()), ("ledger_id", pa.string()), ("raw", pa.float64()), ("gap", pa.float64())]
SHAPE = pa.schema([("seq", pa.int64()), *((f"{side}_{c}", kind) for side in ("bank", "erp") for c, kind in ROW)])


def stored(raw: float) -> float:
    """Rounded half up to two decimals, as shown, and capped."""
    return min(100.0, float(Decimal(repr(raw)).quantize(Decimal("0.01"), ROUND_HALF_UP)))


class Names:
    """Distinct names (sorted tokens) of ledger rows, and the likeness of another name to all of them."""

    def __init__(self, names: list[str]):
        self.names, self.length = names, np.array([len(x) for x in names], np.int64)
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for x in names for c in x}))}
        self.known: OrderedDict[str, np.ndarray] = OrderedDict()
        order = np.argsort(-self.length, kind="stable")
        self.order, self.columns = order, []
        for j in range(int(self.length.max(initial=0))):  # of the names that long, longest first
            self.columns.append(np.array([self.code[names[i][j]] for i in order[: int((self.length > j).sum())]], np.int64))

    def common(self, a: str) -> np.ndarray:
        """Lengths of the longest common subsequences, bit-parallel: bit i is 0 where it grows at the i-th character of ``a``."""
        out = np.zeros(len(self.names), np.int64)
        if len(a) > WORD:
            ones = (1 << len(a)) - 1
            places = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
            for i, b in enumerate(self.names):
                s = ones
                for c in b:
                    u = s & places.get(c, 0)
                    s = ((s + u) | (s - u)) & ones
                out[i] = len(a) - s.bit_count()
            return out
        ones = np.uint64((1 << len(a)) - 1)
        places = np.zeros(len(self.code) + 1, np.uint64)
        for i, c in enumerate(a):
            if c in self.code:
                places[self.code[c]] |= np.uint64(1 << i)
        s = np.full(len(self.names), ones, np.uint64)
        for column in self.columns:
            here = s[: len(column)]
            u = here & places[column]
            s[: len(column)] = ((here + u) | (here - u)) & ones
        out[self.order] = len(a) - np.bitwise_count(s).astype(np.int64)
        return out

    def commons(self, asked: list[str]) -> np.ndarray:
        """The same of several names at once, a row for each."""
        out, short = np.zeros((len(asked), len(self.names)), np.int64), [i for i, a in enumerate(asked) if len(a) <= WORD]
        for i in set(range(len(asked))).difference(short):
            out[i] = self.common(asked[i])
        places = np.zeros((len(short), len(self.code) + 1), np.uint64)
        for i, at in enumerate(short):
            for k, c in enumerate(asked[at]):
                if c in self.code:
                    places[i, self.code[c]] |= np.uint64(1 << k)
        long = np.array([len(asked[i]) for i in short], np.int64)[:, None]
        ones = np.array([(1 << len(asked[i])) - 1 for i in short], np.uint64)[:, None]
        s = np.repeat(ones, len(self.names), axis=1)
        for column in self.columns:
            here = s[:, : len(column)]
            u = here & places[:, column]
            s[:, : len(column)] = ((here + u) | (here - u)) & ones
        out[np.ix_(short, self.order)] = long - np.bitwise_count(s).astype(np.int64)
        return out

    def likenesses(self, asked: list[str]) -> np.ndarray:
        n = self.length + np.array([len(a) for a in asked], np.int64)[:, None]
        score = (1 - (n - 2 * self.commons(asked)) / np.maximum(n, 1).astype(float)) * 100
        at = {x: i for i, x in enumerate(self.names)}
        for i, a in enumerate(asked):
            if a in at:
                score[i, at[a]] = 100.0
        return score

    def likeness(self, a: str) -> np.ndarray:
        if a not in self.known:
            n = self.length + len(a)
            score = (1 - (n - 2 * self.common(a)) / np.maximum(n, 1).astype(float)) * 100
            self.known[a] = np.where(np.array([x == a for x in self.names], bool), 100.0, score)
            if len(self.known) > KEPT:
                self.known.popitem(last=False)
        self.known.move_to_end(a)
        return self.known[a]


class Likeness:
    """Likenesses of names to names of ledger rows, which mostly come again in other references."""

    def __init__(self):
        self.asked, self.held, self.known = {}, {}, np.full((SHARED, SHARED), np.nan)

    def of(self, asked: list[str], held: list[str]) -> np.ndarray:
        """A row for each of ``asked``, a column for each of ``held``, both without repeats."""
        if max(len(asked), len(held)) > SHARED:
            return Names(held).likenesses(asked)
        if any(len(known) + sum(x not in known for x in new) > SHARED for known, new in ((self.asked, asked), (self.held, held))):
            self.known[: len(self.asked), : len(self.held)] = np.nan
            self.asked, self.held = {}, {}
        cells = np.ix_(*([known.setdefault(x, len(known)) for x in new] for known, new in ((self.asked, asked), (self.held, held))))
        out = self.known[cells]
        new = np.isnan(out)
        if new.any():
            rows, columns = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
            out[np.ix_(rows, columns)] = Names([held[i] for i in columns]).likenesses([asked[i] for i in rows])
            self.known[cells] = out
        return out


def reaches(raw: np.ndarray, score: float) -> np.ndarray:
    """Whether these are stored as ``score`` or more."""
    out = raw >= score
    for i in np.flatnonzero(np.abs(raw - score) < 0.01):
        out[i] = stored(float(raw[i])) >= score
    return out


def kept(raw: np.ndarray) -> np.ndarray:
    """The column that the fold of each row's scores in order ends with, -1 where all are -1."""
    wide, at = raw.shape[1], raw.argmax(axis=1)
    top = raw[np.arange(len(at)), at]
    over = top > 100
    at[over] = wide - 1 - (raw[over, ::-1] > 100).argmax(axis=1)
    at[top < 0] = -1
    rest = np.flatnonzero((top >= 0) & ~over)
    like = raw[rest] >= top[rest, None] - 0.011
    several = like.sum(axis=1) > 1
    if several.any():
        rest, like = rest[several], like[several]
        i, j = like.nonzero()
        near = raw[rest[i], j]
        values, which = np.unique(near, return_inverse=True)
        held = np.array([stored(float(v)) for v in values])[which]
        first = np.searchsorted(i, np.arange(rest.size))
        most = np.maximum.reduceat(held, first)[i]
        above, same = np.maximum.reduceat(np.where(near > most, j, -1), first), np.minimum.reduceat(np.where(held == most, j, wide), first)
        at[rest] = np.where(above >= 0, above, same)
    return at


class Side:
    """Ledger rows of one kind of a reference, in order of ``l_seq``, with those that are taken."""

    def __init__(self, pieces: list[pa.RecordBatch], known: Likeness):
        rows = pieces[0] if len(pieces) == 1 else pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        coded = rows.column("payee").dictionary_encode()
        self.seq, self.usd, self.ids, self.name = rows.column("seq").to_numpy(), rows.column("usd").to_numpy(), rows.column("ledger_id"), coded.indices.to_numpy()
        self.words, self.open, self.known = coded.dictionary.to_pylist(), np.ones(rows.num_rows, bool), known
        self.names = Names(self.words) if len(self.words) > SHARED else None

    def likeness(self, who: pa.Array) -> np.ndarray:
        """Of each name to those of the rows."""
        coded = who.dictionary_encode()
        asked = coded.dictionary.to_pylist()
        like = np.stack([self.names.likeness(a) for a in asked]) if self.names else self.known.of(asked, self.words)
        return like[coded.indices.to_numpy()]

    def some(self, who: list[pa.Array], usd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of transfers whose scores fit in memory."""
        like = self.likeness(who[0])
        for a in who[1:]:
            like = np.maximum(like, self.likeness(a))
        raw = like[:, self.name] * 0.4 + np.fmax(0.0, 100 - np.abs(usd[:, None] - self.usd) / (usd[:, None] + 1e-5) * 100) * 0.4 + 40.0
        raw[:, ~self.open] = -1.0
        at = kept(raw)
        got = raw[np.arange(len(at)), at]
        for i, (j, takes) in enumerate(zip(at.tolist(), reaches(got, 90).tolist(), strict=True)):
            if j >= 0 and not self.open[j]:
                one = np.where(self.open, raw[i], -1.0)
                top = float(one.max())
                near = (one > 100 if top > 100 else one >= top - 0.011).nonzero()[0]
                at[i] = j = int(near[-1]) if top > 100 or len(near) == 1 else int(kept(one[None])[0])
                got[i] = one[j]
                takes = top >= 89 and stored(float(one[j])) >= 90
            if takes:
                self.open[j] = False
        return at, got

    def best(self, who: list[pa.Array], usd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, raw score) of what the fold in order ends with for each of the next transfers, -1 for both where no row is open. Those from 90 on take their rows."""
        step = max(1, PAIRS // len(self.seq))
        parts = [self.some([a.slice(i, step) for a in who], usd[i : i + step]) for i in range(0, len(usd), step)]
        at, raw = (parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True)))
        return at, np.where(at < 0, -1.0, raw)

    def found(self, usd: np.ndarray, at: np.ndarray, raw: np.ndarray) -> list[pa.Array]:
        """The columns of ROW, null where nothing is found."""
        none = at < 0
        return [pa.array(self.seq[at], mask=none), self.ids.take(pa.array(at, mask=none)), pa.array(raw, mask=none), pa.array(np.abs(usd - self.usd[at]), mask=none)]


def settled(bank: Side | None, erp: Side | None, transfers: pa.RecordBatch) -> pa.RecordBatch:
    """The best bank row of each of the next transfers of a reference and, where it doesn't reach 85, the best invoice."""
    usd, payer, payee = transfers.column("usd").to_numpy(), transfers.column("payer"), transfers.column("payee")
    banks = erps = [pa.nulls(len(usd), kind) for _, kind in ROW]
    left = np.arange(len(usd))
    if bank:
        at, raw = bank.best([payer, payee], usd)
        banks, left = bank.found(usd, at, raw), np.flatnonzero(~reaches(raw, 85))
    if erp and left.size:
        at, raw = np.full(len(usd), -1), np.full(len(usd), -1.0)
        at[left], raw[left] = erp.best([payee.take(pa.array(left))], usd[left])
        erps = erp.found(usd, at, raw)
    return pa.RecordBatch.from_arrays([transfers.column("seq"), *banks, *erps], schema=SHAPE)


def swept(batches):
    """Arrow batches of sorted rows (key, turn: 0 bank row, 1 invoice, 2 transfer; seq, ledger_id, payer, payee, usd) to those of ``sweep``. A reference may go over several."""
    known, last, held, sides = Likeness(), None, ([], []), None
    for b in batches:
        if not b.num_rows:
            continue
        key, turn, out = b.column("key"), b.column("turn").to_numpy(), []
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0], last = key[0].as_py() != last, key[b.num_rows - 1].as_py()
        cut = new.copy()
        cut[1:] |= turn[1:] != turn[:-1]
        cut[0] = True
        for i, j in pairwise([*np.flatnonzero(cut).tolist(), b.num_rows]):
            if new[i]:
                held, sides = ([], []), None
            if turn[i] < 2:
                held[turn[i]].append(b.slice(i, j - i))
                continue
            if sides is None:
                sides, held = [Side(x, known) if x else None for x in held], ([], [])
            out.append(settled(*sides, b.slice(i, j - i)))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def sweep(rows: DataFrame, parts: int) -> DataFrame:
    """rows (key, kind: 0 ledger row, 1 transfer; seq, side, ledger_id, payer, payee, usd; a ledger row's name is ``payee``) to the
    best bank row of each transfer and, where that doesn't reach 85, the best invoice, as (seq, bank, erp), each (l_seq, ledger_id, raw, gap) or null."""
    order = ["key", "turn", "seq", "ledger_id"]
    turn = F.when(F.col("kind") == 1, 2).when(F.col("side") == "ERP", 1).otherwise(0)
    dealt = rows.select("key", turn.alias("turn"), "seq", "ledger_id", "payer", "payee", "usd").repartition(parts, "key").sortWithinPartitions(*order)
    row = lambda side: F.when(F.col(f"{side}_l_seq").isNotNull(), F.struct(*(F.col(f"{side}_{c}").alias(c) for c, _ in ROW))).alias(side)
    flat = ", ".join(f"{side}_l_seq long, {side}_ledger_id string, {side}_raw double, {side}_gap double" for side in ("bank", "erp"))
    return dealt.mapInArrow(swept, f"seq long, {flat}").select("seq", row("bank"), row("erp"))
