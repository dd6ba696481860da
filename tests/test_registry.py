import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer", "nation", "supplier", "events", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    cols = sorted(names)
    assert sorted(got.columns) == cols
    have = sorted(str([r[c] for c in cols]) for r in got.collect())
    assert have == sorted(str([r[names.index(c)] for c in cols]) for r in want.fetchall())


def test_rivals_equal_the_direct_fold(spark):
    from test_reconcile import direct

    take = lambda df, *cols: [tuple(r) for r in df.select("seq", *cols).where("seq < 1200").collect()]
    few = lambda rows, at: [tuple(None if i == at and r[0] % 50 == 49 else f"R{r[0] // 48}" if i == at else x for i, x in enumerate(r)) for r in rows]
    t, b, e = (registry.payments(spark, SF, n) for n in registry.LEDGERS)
    tx = few(take(t, "transaction_id", "reference_id", "payer", "payee", "amount", "currency"), 2)
    bank = few(take(b, "bank_statement_id", "reference_number", "counterparty", "amount", "currency"), 2)
    erp = few(take(e, "erp_id", "invoice_number", "customer_vendor_name", "expected_amount", "currency"), 2)
    small = lambda df: df.where("seq < 1200")
    got = {x.seq: (x.ledger_id, x.ledger_type, x.amount_difference, x.match_confidence) for x in registry.rivals(small(t), small(b), small(e)).collect()}
    assert got == direct(tx, bank, erp)


def test_forecast_and_entry(spark):
    f = registry.QUERIES["a5_forecast"](spark, SF).toPandas()
    assert len(f) == 7 and (f.predicted_amount >= 1000).all() and (f.lower_bound <= f.predicted_amount).all()
    assert entry.entry(spark).count() == 1


def test_manual_match_of_an_unknown_transfer_is_added(spark):
    from ledgerloom.operators import updates

    have = spark.createDataFrame([(1, "A", None, "BANK", "unmatched", 3.5, 0.0, "low")], "seq long, transaction_id string, ledger_id string, ledger_type string, status string, amount_difference double, match_confidence double, confidence_tier string")
    got = {r.transaction_id: r for r in updates.manual_match(have, spark.createDataFrame([("A", "X"), ("B", "Y")], "transaction_id string, ledger_id string")).collect()}
    assert (got["A"].ledger_id, got["A"].status, got["A"].amount_difference) == ("X", "matched", 3.5)
    assert (got["B"].ledger_id, got["B"].confidence_tier, got["B"].amount_difference) == ("Y", "high", 0.0)
