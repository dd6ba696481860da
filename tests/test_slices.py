"""Slices of many transfers scored at once."""

import random

import numpy as np
import pytest

from ledgerloom.operators import nearest as nr


@pytest.mark.parametrize(("pairs", "many"), [(1 << 18, 1 << 12), (50, 1 << 12), (1 << 18, 3)])
def test_slices_of_many_transfers_at_once(monkeypatch, pairs, many):
    """Their rows are those that each finds by itself, which is looked at by itself only where the slice may be large."""
    monkeypatch.setattr(nr, "PAIRS", pairs)
    monkeypatch.setattr(nr, "MANY", many)
    r = random.Random(5)
    for taken in (0.0, 0.5, 0.95, 1.0):
        usd = np.sort([r.choice([0.0, 50.0, 50.005, 51.0, 99.99, round(r.uniform(1, 200), 2)]) for _ in range(400)])
        turn = np.array(r.sample(range(1000), 400))
        rows = nr.Rows(usd, turn, np.array([r.randrange(900) if r.random() < taken else 2**63 - 1 for _ in usd]), None)
        asked = [(r.randrange(1000), r.choice([0.0, 50.0, 60.0, float("nan"), r.uniform(0, 300)]), r.choice([1e300, 30.0, 0.001]), r.choice([0.0, 70.0, 100.0])) for _ in range(300)]
        one, calls = rows.of_name, []
        monkeypatch.setattr(rows, "of_name", lambda *x, one=one, calls=calls: calls.append(x) or one(*x))
        got = rows.of_names(*(np.array(c) for c in zip(*asked, strict=True)))
        for (seq, mine, wide, score), x in zip(asked, got, strict=True):
            want = None if mine != mine else one(seq, mine, wide, score)
            # a row just beyond ``wide`` may be found, too: it can't win
            assert x == want or want is None and wide < x[3] <= wide + (mine + 1e-5) * nr.STEP / 40 * 1.000002
        if taken < 1 and many > 3:
            assert len(calls) < 150
