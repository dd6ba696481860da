"""The best open ledger row of each transfer, among rows of nearly equal amount.

Pairs are never made, as their number grows with the product of both tables. A block is the ledger rows and the transfers of one amount bucket, of one name or,
where names count as far as they are alike, of any. It comes as one sorted stream: its ledger rows by amount, kept as arrays of numbers, then its
transfers, each of which looks at a slice around its amount and gives one row. What it gives of several blocks is its best of each. Where only amounts tell rows apart, the nearest
row that is open to all of the block's transfers bounds the slice, and the slices of many transfers are scored at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .rivals import PAIRS, Names, stored

#: What makes a block; ``salt`` is -1 for blocks of one name.
BLOCK = ("side", "name", "at", "salt")
#: Rows of a slice up to which it is scored with those of other transfers.
MANY = 1 << 12
#: Scores closer than this can be stored as the same number.
STEP = 0.011
SHAPE = pa.schema([("seq", pa.int64()), ("side", pa.string()), ("l_seq", pa.int64()), ("ledger_id", pa.string()), ("raw", pa.float64()), ("gap", pa.float64())])


def kept(raw: np.ndarray, turn: np.ndarray) -> int:
    """The place that the fold in order of ``turn`` ends with: the last whose score is above the greatest stored one, or else the first stored as it."""
    most = stored(float(raw.max()))
    above = np.flatnonzero(raw > most)
    if above.size:
        return int(above[turn[above].argmax()])
    like = raw > most - 0.005 + 1e-9
    for i in np.flatnonzero(np.abs(raw - (most - 0.005)) <= 1e-9):  # on the edge of rounding
        like[i] = stored(float(raw[i])) == most
    same = np.flatnonzero(like)
    return int(same[turn[same].argmin()])


class Rows:
    """Ledger rows of a block, in order of amount. A row is open to the transfers up to the one that takes it."""

    def __init__(self, usd: np.ndarray, seq: np.ndarray, taken: np.ndarray, names: pa.Array | None):
        self.usd, self.seq, self.taken, self.known = usd, seq, taken, {}
        if names is not None:
            coded = names.dictionary_encode()
            self.name, self.names = coded.indices.to_numpy(), Names(coded.dictionary.to_pylist())

    def between(self, usd: float, gap: float) -> slice:
        return slice(int(self.usd.searchsorted(usd - gap, "left")), int(self.usd.searchsorted(usd + gap, "right")))

    def scores(self, at: slice, seq: int, usd: float, like) -> np.ndarray:
        """Raw scores, -1 of rows that are taken."""
        raw = like * 0.4 + np.maximum(0.0, 100 - np.abs(usd - self.usd[at]) / (usd + 1e-5) * 100) * 0.4 + 0.0
        return np.where(self.taken[at] >= seq, raw, -1.0)

    def of_name(self, seq: int, usd: float, wide: float, score: float) -> tuple | None:
        """Of rows that only amounts tell apart: a slice that grows until a row is open, then all that can be stored as its score."""
        step = (usd + 1e-5) * STEP / 40 * 1.000001
        gap = min(step, wide)
        while True:
            at = self.between(usd, gap)
            raw = self.scores(at, seq, usd, score)
            if raw.size and raw.max() >= 0:
                break
            if gap >= wide or raw.size == self.usd.size:
                return None
            gap = min(gap * 8, wide)
        near = float(np.abs(usd - self.usd[at])[raw.argmax()])
        # all amounts score 0 that are off by more than the transfer's own
        at = self.between(usd, near + step if near + step < usd + 1e-5 else wide)
        return self.best(at, self.scores(at, seq, usd, score), usd)

    def of_names(self, seq: np.ndarray, usd: np.ndarray, wide: np.ndarray, score: np.ndarray) -> list[tuple | None]:
        """``of_name`` of many transfers."""
        sure = np.concatenate([[-np.inf], self.usd[self.taken >= seq.max()], [np.inf]])
        at, step = sure[1:-1].searchsorted(usd), (usd + 1e-5) * STEP / 40 * 1.000001
        with np.errstate(invalid="ignore"):
            gap = np.minimum(np.minimum(usd - sure[at], sure[at + 1] - usd), wide) + step
            first, n = self.usd.searchsorted(usd - gap, "left"), self.usd.searchsorted(usd + gap, "right")
            n -= first
            quick = (gap < usd + 1e-5) & (n <= MANY)
        out: list[tuple | None] = [None] * len(seq)
        for k in np.flatnonzero(~quick & ~np.isnan(usd)).tolist():
            out[k] = self.of_name(int(seq[k]), float(usd[k]), float(wide[k]), float(score[k]))
        quick = np.flatnonzero(quick & (n > 0))
        many = max(1, PAIRS // int(n[quick].max(initial=1)))
        for k in (quick[i : i + many] for i in range(0, len(quick), many)):
            starts = np.cumsum(n[k]) - n[k]
            which = np.repeat(np.arange(len(k)), n[k])
            rows, mine = np.arange(len(which)) + (first[k] - starts)[which], usd[k][which]
            raw = score[k][which] * 0.4 + np.maximum(0.0, 100 - np.abs(mine - self.usd[rows]) / (mine + 1e-5) * 100) * 0.4 + 0.0
            raw[self.taken[rows] < seq[k][which]] = -1.0
            top = np.maximum.reduceat(raw, starts)
            near = raw >= top[which] - STEP
            alone, last = np.add.reduceat(near.astype(np.int64), starts) == 1, np.maximum.reduceat(np.where(near, rows, -1), starts)
            for i in np.flatnonzero(top >= 0).tolist():
                j, at = int(last[i]), slice(int(starts[i]), int(starts[i] + n[k[i]]))
                if not alone[i]:
                    j = int(rows[at.start + kept(raw[at], self.seq[rows[at]])])
                out[k[i]] = (int(self.seq[j]), j, float(raw[at.start + j - rows[at.start]]), float(abs(usd[k[i]] - self.usd[j])))
        return out

    def of_any(self, seq: int, usd: float, wide: float, side: str, payer: str, payee: str) -> tuple | None:
        who = (payer, payee) if side == "BANK" else (payee,)
        if who not in self.known:
            like = self.names.likeness(who[0])
            for a in who[1:]:
                like = np.maximum(like, self.names.likeness(a))
            self.known = {who: like}  # the transfers come by name
        at = self.between(usd, wide)
        raw = self.scores(at, seq, usd, self.known[who][self.name[at]])
        return self.best(at, raw, usd) if raw.size and raw.max() >= 0 else None

    def best(self, at: slice, raw: np.ndarray, usd: float) -> tuple:
        i = kept(raw, self.seq[at]) if raw.size > 1 else 0
        j = at.start + i
        return int(self.seq[j]), j, float(raw[i]), float(abs(usd - self.usd[j]))


class Batch:
    """Columns as numbers; strings are read only where they are needed."""

    def __init__(self, b: pa.RecordBatch):
        self.arrow = b
        self.kind, self.usd, self.seq, self.score, self.wide = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "usd", "seq", "score", "wide"))
        self.taken = pc.fill_null(b.column("taken_at"), 0).to_numpy()

    def block(self, i: int, j: int) -> list[tuple]:
        """(seq, side, l_seq, ledger_id, raw, gap) of the transfers of the block in rows i to j."""
        n = i + int(self.kind[i:j].searchsorted(1))
        if n in (i, j):
            return []
        named, side, out = self.arrow.column("salt")[i].as_py() < 0, self.arrow.column("side")[i].as_py(), []
        ids, payer, payee = (self.arrow.column(c) for c in ("ledger_id", "payer", "payee"))
        rows = Rows(self.usd[i:n], self.seq[i:n], self.taken[i:n], None if named else payee.slice(i, n - i))
        if named:
            every = rows.of_names(self.seq[n:j], self.usd[n:j], self.wide[n:j], self.score[n:j])
            return [(int(seq), side, got[0], ids[i + got[1]].as_py(), *got[2:]) for seq, got in zip(self.seq[n:j], every, strict=True) if got]
        for k, a, b in sorted(zip(range(n, j), payer.slice(n, j - n).to_pylist(), payee.slice(n, j - n).to_pylist(), strict=True), key=lambda x: x[1:]):
            seq, usd, wide = int(self.seq[k]), float(self.usd[k]), float(self.wide[k])
            if math.isnan(usd):
                continue
            got = rows.of_any(seq, usd, wide, side, a, b)
            if got:
                out.append((seq, side, got[0], ids[i + got[1]].as_py(), *got[2:]))
        return out


def joined(pieces: list[pa.RecordBatch]) -> list[tuple]:
    """The same of a block in several batches."""
    whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()
    return Batch(whole[0]).block(0, whole[0].num_rows)


def nearest(rows: DataFrame, parts: int) -> DataFrame:
    """rows (BLOCK; kind: 0 ledger row, 1 transfer; usd, seq, taken_at: the last transfer a ledger row is open to; ledger_id, score: a transfer's for the
    block's name; wide: the amount that a row may be off by; payer, payee: where names differ; a ledger row's name is ``payee``) to the best row of each transfer and
    block, as (seq, side, l_seq, ledger_id, raw, gap)."""

    def go(batches):
        pieces, last = [], None  # of the block that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            new, out = np.zeros(b.num_rows, bool), []
            for c in BLOCK:
                new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = tuple(b.column(c)[0].as_py() for c in BLOCK)
            new[0] = first != last
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in BLOCK)
            starts = np.flatnonzero(new)
            until = int(starts[0]) if starts.size else b.num_rows
            if until:
                pieces.append(b.slice(0, until))
            if starts.size:
                if pieces:
                    out += joined(pieces)
                here = Batch(b)
                both = (here.kind[starts[:-1]] == 0) & (here.kind[starts[1:] - 1] == 1)
                for i, j in zip(starts[:-1][both].tolist(), starts[1:][both].tolist(), strict=True):
                    out += here.block(i, j)
                pieces = [b.slice(int(starts[-1]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SHAPE, strict=True)], schema=SHAPE)
        out = joined(pieces) if pieces else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SHAPE, strict=True)], schema=SHAPE)

    columns = [*BLOCK, "kind", "usd", "seq", "taken_at", "ledger_id", "score", "wide", "payer", "payee"]
    dealt = rows.repartition(parts, *BLOCK).sortWithinPartitions(*BLOCK, "kind", "usd")
    return dealt.select(*columns).mapInArrow(go, "seq long, side string, l_seq long, ledger_id string, raw double, gap double")
