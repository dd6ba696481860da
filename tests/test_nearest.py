"""The block search against all pairs, and that no pairs are made."""

import random

import pytest

from ledgerloom.operators import nearest as nr
from ledgerloom.operators import reconcile as rc

from test_reconcile import alike, direct, half_up, numbered, tables

SHAPE = "side string, name string, level int, at long, salt int, kind int, usd double, seq long, taken_at long, ledger_id string, score double, wide double, payer string, payee string"


@pytest.mark.parametrize("named", [True, False])
def test_best_open_row_of_a_block(spark, named):
    r = random.Random(3)
    who = ["ann lee", "bob", "", "cid and company", "x" * 70]
    money = lambda: r.choice([0.0, 10.0, 10.0005, 10.001, 99.99, 100.0, 100.002, round(r.uniform(1, 5000), 2)])
    rows = []
    for block in range(3):  # one of them goes over several batches
        key = ("BANK" if block % 2 else "ERP", f"n{block}" if named else "", 0, block, -1 if named else block)
        rows += [(*key, 0, money(), i + 1, r.choice([2**63 - 1, r.randrange(80)]), f"L{block}-{i}", None, None, None, None if named else r.choice(who)) for i in range((300, 12000, 1)[block])]
        rows += [(*key, 1, money(), block * 100 + i, None, None, 70.0 if named else 0.0, 1e300, None if named else r.choice(who), None if named else r.choice(who)) for i in range(60)]
    want = {}
    for t in rows:
        if t[5] == 1:
            fold, best = (0.0, None), None
            held = sorted((x for x in rows if x[5] == 0 and x[:5] == t[:5] and x[8] >= t[7]), key=lambda x: x[7])
            for x in held:
                like = t[10] if named else max(alike(a, x[13]) for a in ((t[12], t[13]) if t[0] == "BANK" else (t[13],)))
                raw = like * 0.4 + max(0.0, 100 - abs(t[6] - x[6]) / (t[6] + 1e-5) * 100) * 0.4 + 0.0
                if best is None or raw > fold[0]:
                    fold, best = (min(100.0, half_up(raw)), x), (t[7], t[0], x[7], x[9], raw, abs(t[6] - x[6]))
            if best:
                want[t[7]] = best
    got = {x.seq: tuple(x) for x in nr.nearest(spark.createDataFrame(rows, SHAPE), 2).collect()}
    assert got == want


def peak(spark, run) -> float:
    """Most memory, in MB, that the tasks of one stage took in all."""
    status, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: status.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    after = stages()
    return max(after.apply(i).peakExecutionMemory() for i in range(after.size()) if after.apply(i).stageId() not in seen) / 1e6


def test_equal_names_and_amounts_make_no_pairs(spark):
    """3,000 transfers could each take any of 3,000 rows: 9 million pairs, if they were made."""
    tx = numbered([(f"T{i}", None, "Ann", "Bob", 100.0, "USD") for i in range(3000)])
    bank = numbered([(f"B{i}", None, "Ann", 100.0, "USD") for i in range(3000)])
    got = []
    used = peak(spark, lambda: got.extend(rc.reconcile(*tables(spark, tx, bank, [])).select("seq", "ledger_id", "match_confidence").collect()))
    assert {x.ledger_id for x in got} == {"B0"} and {x.match_confidence for x in got} == {80.0} and len(got) == 3000
    assert used < 700
    few = tables(spark, tx[:20], bank[:20], [])
    assert {x.seq: (x.ledger_id, x.ledger_type, x.amount_difference, x.match_confidence) for x in rc.reconcile(*few).collect()} == direct(tx[:20], bank[:20], [])
