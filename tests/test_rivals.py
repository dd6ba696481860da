"""Transfers that share a reference: many scored at once, against the direct fold."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import rivals

from test_reconcile import alike, direct

SHAPE = "key string, kind int, seq long, side string, ledger_id string, payer string, payee string, usd double"


def references(r, n):
    """Of each reference its transfers, bank rows and invoices, as ``direct`` takes them; names come again, some are long or empty."""
    who = ["ann lee", "ann lee ltd", "bob", "", "cid and company", "x" * 70, "x" * 69 + "y", "dora"]
    some = lambda: r.sample(who, 3) + ["".join(r.choice("abcde ") for _ in range(9))]
    money = lambda: r.choice([0.0, 10.0, 10.0005, 10.1, 99.99, 100.0, 101.0, 5000.0])
    out = {}
    for k in range(n):
        names, seqs = [" ".join(sorted(x.split())) for x in some()], r.sample(range(k * 100, k * 100 + 100), 60)
        rows = lambda kind, at, names=names: [(i, f"{kind}{i}", f"R{k}", r.choice(names), money(), "USD") for i in sorted(at)]  # noqa: B023, E731
        asked = [(i, f"T{i}", f"R{k}", r.choice(names), r.choice(names), money(), "USD") for i in sorted(seqs[:25])]
        out[f"R{k}"] = (asked, rows("B", seqs[25:45] if k % 5 else []), rows("E", seqs[45:] if k % 7 else []))
    return out


def stream(refs, size):
    rows = []
    for key, (tx, bank, erp) in sorted(refs.items()):
        rows += [(key, turn, i, ident, None, name, usd) for turn, side in enumerate((bank, erp)) for i, ident, _, name, usd, _ in side]
        rows += [(key, 2, i, None, payer, payee, usd) for i, _, _, payer, payee, usd, _ in tx]
    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["key", "turn", "seq", "ledger_id", "payer", "payee", "usd"]), size


def chosen(rows):
    """The result of each transfer by its best bank row and invoice."""
    out = {}
    for x in rows:
        held = rivals.stored(x["bank_raw"]) if x["bank_ledger_id"] else 0.0
        side = "erp" if x["erp_ledger_id"] and held < 85 and x["erp_raw"] > held else "bank"
        assert x["bank_raw"] is None or held < 85 or x["erp_l_seq"] is None
        out[x["seq"]] = (x[f"{side}_ledger_id"], side.upper(), rivals.stored(x[f"{side}_raw"] or 0.0))
    return out


@pytest.mark.parametrize(("size", "pairs", "shared"), [(1000, 1 << 18, 1024), (7, 90, 1024), (1, 1, 2), (90, 500, 9)])
def test_many_at_once_equal_the_direct_fold(monkeypatch, size, pairs, shared):
    """However rows come in batches, scores fit in memory and names are kept."""
    monkeypatch.setattr(rivals, "PAIRS", pairs)
    monkeypatch.setattr(rivals, "SHARED", shared)
    refs = references(random.Random(size), 40)
    whole, size = stream(refs, size)
    got = chosen(x for b in rivals.swept(iter(whole.slice(i, size) for i in range(0, whole.num_rows, size))) for x in b.to_pylist())
    want = {seq: (ident, side, best) for one in refs.values() for seq, (ident, side, _, best) in direct(*one).items()}
    assert got == want and len(want) == 1000


def test_names_are_compared_once_for_many_references(monkeypatch):
    seen, real = [], rivals.Names.commons
    monkeypatch.setattr(rivals.Names, "commons", lambda self, asked: (seen.extend((a, b) for a in asked for b in self.names), real(self, asked))[1])
    refs = {f"R{k:03}": ([(i, f"T{i}", "", "ann", "bob", 10.0, "USD") for i in (1, 2, 3)], [(i, f"B{i}", "", "anna", 10.0, "USD") for i in (1, 2)], [(1, "E1", "", "bo", 10.0, "USD")]) for k in range(100)}
    assert sum(b.num_rows for b in rivals.swept(iter([stream(refs, 0)[0]]))) == 100 * 3
    assert sorted(seen) == [("ann", "anna"), ("bob", "anna"), ("bob", "bo")]


def test_names_of_several_at_once():
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcd é") for _ in range(r.choice([0, 1, 5, 62, 63, 64, 90])))
    asked, held = sorted({name() for _ in range(40)}), sorted({name() for _ in range(40)} | {""})
    got = rivals.Names(held).likenesses([*asked, ""])
    plain = lambda n: " ".join(sorted(n.split())) == n
    assert all(got[i, j] == alike(a, b) for i, a in enumerate(asked) for j, b in enumerate(held) if plain(a) and plain(b))
    assert np.array_equal(got, np.stack([rivals.Names(held).likeness(a) for a in [*asked, ""]]))


def test_no_invoice_is_looked_at_where_a_bank_row_reaches_85(spark):
    """Its best invoice can't be chosen, nor is it taken."""
    asked = [("R", 1, i, None, None, "ann", "bob", 10.0) for i in range(4)]
    held = [("R", 0, i, "BANK", f"B{i}", None, "ann", 10.0) for i in range(3)] + [("R", 0, i, "ERP", f"E{i}", None, "bob", 10.0) for i in range(2)]
    id_of = lambda x: x and x.ledger_id
    got = {(x.seq, id_of(x.bank), id_of(x.erp)) for x in rivals.sweep(spark.createDataFrame(asked + held, SHAPE), 2).collect()}
    assert got == {(0, "B2", None), (1, "B1", None), (2, "B0", None), (3, None, "E1")}
