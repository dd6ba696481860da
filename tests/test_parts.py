"""Rules, report rollups, ingestion order, requests, sinks, and steps in sessions without a checkpoint folder."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import logs as lg
from ledgerloom.operators import messages as ms
from ledgerloom.operators import rail
from ledgerloom.sources import ingest, sinks
from ledgerloom.sources.versioned import latest
from ledgerloom.sources.payments import payments

SF = "/root/testdata/sf0.001"


def test_number_operators(spark):
    """The same rules over amounts as text as in the rule engine's own test."""
    ops = [("numberStringLessThanInclusive", 50), ("numberStringGreaterThanInclusive", 50), ("numericEqual", "50"), ("numericNotEqual", "50"), ("numericLessThan", "50"), ("numericGreaterThan", "50"), ("numericLessThanInclusive", "50"), ("numericGreaterThanInclusive", "50")]
    rows = spark.createDataFrame([("49",), ("50",), ("51",), ("",), (None,), ("fifty",), ("5d",)], "amount string")
    got = {r[0]: {op for (op, _), x in zip(ops, r[1:], strict=True) if x} for r in rows.select("amount", *(ms.condition({"fact": "amount", "operator": op, "value": v}).alias(op) for op, v in ops)).collect()}
    low, high, same = {"numberStringLessThanInclusive", "numericLessThan", "numericLessThanInclusive"}, {"numberStringGreaterThanInclusive", "numericGreaterThan", "numericGreaterThanInclusive"}, {"numericEqual"}
    assert got["49"] == got[""] == low | {"numericNotEqual"} and got["51"] == high | {"numericNotEqual"}
    assert got["50"] == (low | high | same) - {"numericLessThan", "numericGreaterThan"}
    assert got[None] == got["fifty"] == got["5d"] == {"numericNotEqual"}


def test_other_operators_and_paths(spark):
    rows = spark.createDataFrame([("get", ["a", "b"], {"k": "v"}, '{"p":{"q":7,"s":"7","t":true}}'), (None, None, None, None)], "m string, l array<string>, h map<string,string>, body string")
    c = lambda fact, op, value, path="": ms.condition({"fact": fact, "operator": op, "value": value} | ({"path": path} if path else {}), rows.schema)
    cases = [
        (c("m", "equal", "get"), True, False), (c("m", "notEqual", "get"), False, True), (c("m", "in", ["get", "put"]), True, False), (c("m", "notIn", ["get"]), False, True), (c("m", "excludesString", "x"), True, True), (c("m", "equal", 7), False, False),
        (c("l", "contains", "a"), True, False), (c("l", "doesNotContain", "z"), True, False), (c("h", "equal", "v", "k"), True, False), (c("h", "equal", "v", "z"), False, False),
        (c("body", "equal", 7, "$.p.q"), True, False), (c("body", "equal", "7", "p.q"), False, False), (c("body", "equal", "7", "p.s"), True, False), (c("body", "equal", True, "p.t"), True, False), (c("body", "greaterThan", 6, "p.q"), True, False), (c("body", "numericNotEqual", 7, "p.none"), True, True),
    ]
    got = rows.select("m", *(x.alias(f"c{i}") for i, (x, _, _) in enumerate(cases))).collect()
    first, null = (next(r for r in got if (r.m is None) == n) for n in (False, True))
    assert [tuple(first)[1:], tuple(null)[1:]] == [tuple(x for _, x, _ in cases), tuple(x for _, _, x in cases)]


def test_exposure_of_a_hot_provider(spark):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "post", ["/transfers", "/quotes"][i % 2], "hot" if i % 3 else None, float(i)) for i in range(600)]
    m = spark.createDataFrame(rows, "seq long, ts string, method string, path string, payee_fsp string, amount double").withColumn("ts", F.col("ts").cast("timestamp"))
    used, want = {}, {}
    for seq, _, _, path, fsp, amount in rows:
        if path == "/quotes":
            want[seq] = 1000 - used.get(fsp, 0)
        else:
            used[fsp] = used.get(fsp, 0) + amount
    assert {r.seq: r.allowed for r in ms.exposure(m).collect()} == want


def test_report_rollup(spark):
    """Two cases of six requests: some without tests, some without counts."""
    request = lambda n, p: {"request": {"tests": {"assertions": [{"exec": "x"}] * n, "passedAssertionsCount": p}} if n is not None else {"tests": {}}}
    cases = [[request(5, 4), request(3, 3), request(None, None)], [request(2, 0), request(1, 1), request(None, None)]]
    shape = "test_cases array<struct<name: string, requests: array<struct<description: string, tests: struct<assertions: array<struct<exec: string>>, passedAssertionsCount: int>>>>>"
    doc = json.dumps({"test_cases": [{"name": f"case {i}", "requests": [r["request"] | {"description": "same"} if j < 2 else r["request"] for j, r in enumerate(c)]} for i, c in enumerate(cases)]})
    rows = spark.createDataFrame([(doc,), ('{"test_cases":[{"requests":null}]}',), ("{}",)], "d string").select(F.from_json("d", shape).alias("x")).select("x.*")
    got = sorted(lg.rollup(rows).drop("test_cases").collect(), reverse=True)
    assert got[0] == (11, 8, 3, 2, 2, 6, 2)
    assert sorted(got[1:]) == [(0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0, 0)]
    assert {(r.test, r.request): (r.assert_success, r.assert_fail) for r in lg.assertion_counters(rows.limit(1)).collect()} == {("case 0", "same"): (7, 1), ("case 0", None): (0, 0), ("case 1", "same"): (1, 2), ("case 1", None): (0, 0)}


def test_files_in_order(spark, tmp_path):
    for n, payer in ((1, "first"), (2, "second")):
        (tmp_path / f"{n}.csv").write_text("transaction_id,payer,amount\n" + "".join(f"T{i},{payer}{i},{i}\n" for i in range(500)) + f"T7,again{n},1\n")
    good, bad = ingest.ingest(ingest.read_csv(spark, str(tmp_path)).repartition(5), "ledger")
    assert {r.payer for r in good.collect()} == {f"first{i}" for i in range(500)} and bad.where("reason = 'duplicate_in_file'").count() == 502
    strict, _ = ingest.ingest(spark.createDataFrame([("A", "x")], "transaction_id string, amount string"), "ledger", strict=True)
    with pytest.raises(Exception, match="not an amount"):
        strict.collect()


def test_requests(spark):
    ok = {"quoteId": "q", "transactionId": "t", "payee": {"a": 1}, "payer": {}, "amount": {"amount": "5"}, "transactionType": {}}
    rows = spark.createDataFrame([(1, json.dumps(ok)), (2, json.dumps({k: v for k, v in ok.items() if k != "payer"})), (3, "nonsense")], "n int, body string")
    valid, rejected = ingest.checked_requests(rows)
    assert [(r.n, r.amountType, r.amount["amount"]) for r in valid.collect()] == [(1, "SEND", "5")]
    assert {r.n: r.reason for r in rejected.collect()}[2] == "missing: payer" and rejected.count() == 2
    one = ok | {"transactionRequestId": "r"}
    assert ingest.checked_requests(spark.createDataFrame([(json.dumps(one),)], "body string"), "transaction")[0].first().transactionRequestId == "r"


def test_sinks(spark, tmp_path):
    t, b = payments(spark, SF, "transactions"), payments(spark, SF, "bank_transactions")
    sinks.export_json({"transactions": t, "bank": b, "erp": payments(spark, SF, "erp_records"), "results": b.limit(3), "anomalies": b.limit(0)}, str(tmp_path / "out"))
    n = {r.table_name: r.n for r in spark.read.json(str(tmp_path / "out/metadata")).collect()}
    assert n["transactions"] == t.count() == spark.read.json(str(tmp_path / "out/transactions")).count() and n["anomalies"] == 0
    for _ in range(2):
        sinks.refresh(b, str(tmp_path / "t"))
    assert latest(spark, str(tmp_path / "t")).count() == b.count()
    assert not spark.catalog.listTables()  # no view is left in the user's session


def test_headers_there_and_back(spark):
    h = F.create_map(F.lit("ACCEPT"), F.lit(rail.PLAIN + "quotes+json"), F.lit("Content-Type"), F.lit(rail.PLAIN + "quotes+json"))
    there = rail.rewritten(h, F.lit("post"), F.lit("/quotes"))
    back = rail.rewritten(there, F.lit("post"), F.lit("/quotes"), back=True)
    x = spark.range(1).select(there.alias("t"), back.alias("b"), h.alias("h")).first()
    assert x.t["ACCEPT"].startswith(rail.ISO) and x.b == x.h


@pytest.mark.parametrize("folder", ["", "plain"])
def test_steps_without_setting(folder, tmp_path):
    """In a session of its own: no checkpoint folder, or one without scheme."""
    given = f'.config("spark.checkpoint.dir", "{tmp_path}/steps")' if folder else ""
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]"){given}.config("spark.ui.enabled", "false").getOrCreate()
import ledgerloom.steps as st
if not {bool(folder)}:
    s.conf.get = lambda *a, f=s.conf.get: None if a[0] == "spark.checkpoint.dir" else f(*a)
x = st.materialize(s.range(5))
assert x.count() == 5 and len(st.written()) == 1 and "://" in st.written()[0].replace("file:/", "file:///") and ({bool(folder)} is False or "steps" in st.written()[0])
st.release()
assert not st.written()
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], timeout=200)
    assert "fine" in done.stdout, done.stderr[-2000:]
