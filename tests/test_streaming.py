import json

from ledgerloom.operators import messages as ms
from ledgerloom.operators import rail
from ledgerloom.sources import ingest
from ledgerloom.sources.payments import payments
from ledgerloom.streaming import feeds

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, folder, files=1):
    df.repartitionByRange(files, "ts", "seq").sortWithinPartitions("ts", "seq").write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(folder)


def collected(stream, spark, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_exposure_as_in_batch(spark, tmp_path):
    m = payments(spark, SF, "messages")
    got = collected(feeds.exposure(stream_of(spark, m, str(tmp_path / "in"))), spark, "exposure", tmp_path)
    assert got == sorted(map(tuple, ms.exposure(m).collect()), key=str)


def test_association_as_in_batch(spark, tmp_path):
    m = payments(spark, SF, "messages")
    got = collected(feeds.associate(stream_of(spark, m, str(tmp_path / "in")), 24 * 60), spark, "associated", tmp_path)
    assert got == sorted(map(tuple, rail.associate_quotes(m, 24 * 60).collect()), key=str)


def test_callbacks_as_in_batch(spark, tmp_path):
    """Listeners wait over batches; those without a callback in time are told so once the watermark has passed."""
    at = lambda df: df.selectExpr("id", "method", "path", "timestamp_seconds(s) as ts")
    shape = "id long, method string, path string, s long"
    listening = [(1, "put", "/a", 100), (2, "put", "/a", 104), (3, "put", "/b", 100), (4, "post", "/a", 100), (5, "put", "/a", 130), (6, "put", None, 100)]
    said = [[(10, "put", "/a", 99), (11, "put", "/a", 104), (12, "put", "/a", 104)], [(13, "put", "/b", 116), (14, "put", "/a", 145), (15, "put", None, 101)], [(16, "get", "/z", 9000)]]
    listeners, inbound = at(spark.createDataFrame(listening, shape)), at(spark.createDataFrame(sum(said, []), shape))
    listeners.write.parquet(str(tmp_path / "listeners"))
    (tmp_path / "inbound").mkdir()
    calls = feeds.await_callbacks(spark.readStream.schema(listeners.schema).parquet(str(tmp_path / "listeners")).withColumnRenamed("id", "listener"), spark.readStream.schema(inbound.schema).parquet(str(tmp_path / "inbound")).withColumnRenamed("id", "seq"))
    for rows in said:
        at(spark.createDataFrame(rows, shape)).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbound"))
        calls.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = rail.await_callbacks(listeners.withColumnRenamed("id", "listener"), inbound.withColumnRenamed("id", "seq"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, want.collect())) == [(1, 11), (2, 11), (3, None), (4, None), (5, 14), (6, None)]


def test_feed_keeps_the_first_of_each_id(spark, tmp_path):
    def send(n, *rows):
        folder = tmp_path / "feed"
        folder.mkdir(exist_ok=True)
        full = {"payer": "p", "payee": "q", "payerFsp": "a", "payeeFsp": "b"}
        (folder / f"{n}.txt").write_text("\n".join(json.dumps(full | r) for r in rows))

    def run():
        rows = feeds.transfers(spark.readStream.text(str(tmp_path / "feed")))
        feeds.start(rows, feeds.append_new(str(tmp_path / "table")), str(tmp_path / "c")).awaitTermination()
        return {r.transaction_id: r for r in spark.read.parquet(str(tmp_path / "table")).collect()}

    send(1, {"transactionId": "a", "amount": 1.5}, {"transactionId": "a", "amount": 9}, {"payer": "nobody"})
    assert run()["a"].amount == 1.5
    send(2, {"transactionId": "a", "amount": 7}, {"transactionId": "b", "amount": 2, "currency": "KES"})
    got = run()
    assert (got["a"].amount, got["a"].currency, got["b"].currency, len(got)) == (1.5, "USD", "KES", 2)


def test_state_updates_and_history(spark, tmp_path):
    tx = spark.createDataFrame([("a", "NEW", "R"), ("b", "NEW", "R")], "transaction_id string, status string, transfer_state string")
    shape = "transaction_id string, status string, transfer_state string, ts timestamp, seq long"
    states = lambda: feeds.read_parts(spark, tx.schema, [f for _, f in feeds.newest_parts(spark, str(tmp_path / "states")).values()])
    for n, rows in enumerate([[("a", "1", "x", 10, 0), ("a", "2", "x", 20, 1), ("z", "9", "z", 5, 2)], [("b", "3", "y", 700, 3), ("a", "4", "y", 690, 4)]]):
        df = spark.createDataFrame(rows, "transaction_id string, status string, transfer_state string, s long, seq long").selectExpr("transaction_id", "status", "transfer_state", "timestamp_seconds(s) as ts", "seq")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, batch in (("states", feeds.state_updates(str(tmp_path / "states"), tx)), ("history", feeds.retained(str(tmp_path / "history")))):
            feeds.start(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), batch, str(tmp_path / f"{name}-c")).awaitTermination()
            got = (states() if name == "states" else feeds.latest(spark, str(tmp_path / name))).collect()
            if name == "states":
                assert {r.transaction_id: r.status for r in got} == [{"a": "2", "b": "NEW"}, {"a": "4", "b": "3"}][n]
            else:
                assert {r.seq for r in got} == [{0, 1, 2}, {3, 4}][n]
    again = feeds.state_updates(str(tmp_path / "states"), tx)
    again(spark.read.parquet(str(tmp_path / "in")).where("seq > 2"), 1)  # a batch that runs once more
    assert {r.transaction_id: r.status for r in states().collect()} == {"a": "4", "b": "3"}


def test_reconcile_after_each_batch(spark, tmp_path):
    """The feed hands the whole table to the batch job once per micro-batch."""
    from ledgerloom.operators import reconcile as rc

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/1.txt").write_text(json.dumps({"transactionId": "t", "referenceId": "R", "payer": "Ann", "payee": "Bob", "payerFsp": "x", "payeeFsp": "y", "amount": 5.0}))
    bank = spark.createDataFrame([(1, "B", "R", "Ann", 5.0, "USD")], "seq long, bank_statement_id string, reference_number string, counterparty string, amount double, currency string")
    erp = spark.createDataFrame([], "seq long, erp_id string, invoice_number string, customer_vendor_name string, expected_amount double, currency string")
    seen = []
    after = lambda t: seen.append(rc.reconcile(t.selectExpr("cast(1 as long) as seq", "*"), bank, erp).first().status)
    feeds.start(feeds.transfers(spark.readStream.text(str(tmp_path / "feed"))), feeds.append_new(str(tmp_path / "t"), after=after), str(tmp_path / "c")).awaitTermination()
    assert seen == ["matched"]


def test_upload(spark, tmp_path):
    (tmp_path / "f.csv").write_text("transaction_id,Payer Name,amount\nA,Ann,1\n,Bob,2\n,,\nA,Cid,3\nB,Dan,x\n")
    good, bad = ingest.ingest(ingest.read_csv(spark, str(tmp_path / "f.csv")), *ingest.route("HUB", "f.csv"))
    rows = {r.payer: r for r in good.collect()}
    assert set(rows) == {"Ann", "Bob", "Unknown Payer"} and rows["Unknown Payer"].amount == 0.0
    assert rows["Bob"].transaction_id.startswith("TX-") and rows["Bob"].transaction_id != rows["Unknown Payer"].transaction_id
    assert sorted((r.transaction_id, r.reason) for r in bad.collect()) == [("A", "duplicate_in_file"), ("B", "bad_amount")]
    assert ingest.route(None, "x.XLSX") == ("ledger", "sheet")


def test_messages_are_kept_or_rejected(spark):
    ok = {"transactionId": "t", "payer": "p", "payee": "q", "payerFsp": "a", "payeeFsp": "b", "amount": 2.5}
    texts = [json.dumps(ok), json.dumps(ok | {"amount": "3"}), "{bad", "", None, "[1]", "7", json.dumps({"payer": "p"}), json.dumps(ok | {"amount": "many"}), json.dumps(ok | {"amount": None})]
    good, bad = feeds.checked_transfers(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string"))
    assert sorted(r.amount for r in good.collect()) == [2.5, 3.0]
    reasons = {r.n: r.reason for r in bad.collect()}
    assert [reasons[i] for i in (2, 3, 4, 5, 6)] == ["no JSON object"] * 5
    assert reasons[7] == "missing: transactionId, payee, payerFsp, payeeFsp, amount" and reasons[8] == "amount is no number" and reasons[9] == "missing: amount"


def test_exposure_with_missing_amounts(spark, tmp_path):
    """Nulls count as nothing, and thousandths are kept."""
    rows = [(1, 1, "/transfers", "f", None), (2, 2, "/transfers", "f", 0.125), (3, 3, "/quotes", "f", 999.876), (4, 4, "/quotes", "f", 999.875), (5, 5, "/quotes", "f", None), (6, 6, "/quotes", None, 1001.0)]
    m = spark.createDataFrame(rows, "seq long, s long, path string, payee_fsp string, amount double").selectExpr("seq", "timestamp_seconds(s) as ts", "'post' as method", "path", "payee_fsp", "amount")
    want = {r.seq: (r.allowed, r.error) for r in ms.exposure(m).collect()}
    assert want == {3: (999.875, "5100"), 4: (999.875, None), 5: (999.875, None), 6: (1000.0, "5100")}
    got = collected(feeds.exposure(stream_of(spark, m, str(tmp_path / "in"))), spark, "missing", tmp_path)
    assert {r[0]: (r[3], r[4]) for r in got} == want


def test_daily_flow_of_a_stream(spark, tmp_path):
    """A day comes once the watermark has passed it; later transfers of it are dropped."""
    from ledgerloom.operators import forecast

    def send(n, *rows):
        spark.createDataFrame(rows, "at string, amount double").selectExpr("cast(at as timestamp) as created_at", "amount").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flow = forecast.flow_stream(spark.readStream.schema("created_at timestamp, amount double").parquet(str(tmp_path / "in")), "6 hours")
        flow.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {str(r.day): r.amount for r in spark.read.schema("day date, amount double").parquet(str(tmp_path / "out")).collect()}

    assert send(1, ("2024-01-01 05:00:00", 1.0), ("2024-01-01 23:59:59", 2.0), ("2024-01-02 01:00:00", 4.0)) == {}
    assert send(2, ("2024-01-01 20:00:00", 8.0), ("2024-01-02 07:00:00", None)) == {"2024-01-01": 11.0}
    assert send(3, ("2024-01-01 21:00:00", 16.0), ("2024-01-03 06:00:01", 32.0)) == {"2024-01-01": 11.0, "2024-01-02": 4.0}


def test_one_update_rewrites_one_part(spark, tmp_path):
    from ledgerloom.sources import versioned

    path = str(tmp_path / "t")
    tx = spark.range(500).selectExpr("concat('T', id) as transaction_id", "'NEW' as status", "'R' as transfer_state")
    batch = feeds.state_updates(path, tx, str(tmp_path / "unknown"), parts=16)
    before = versioned.newest_parts(spark, path)
    shape = "transaction_id string, status string, transfer_state string, ts int, seq int"
    batch(spark.createDataFrame([("T7", "DONE", "C", 1, 1), ("none", "x", "y", 1, 1)], shape), 0)
    after = versioned.newest_parts(spark, path)
    moved = {p for p in after if after[p] != before.get(p)}
    assert 1 <= len(moved) <= 2 and spark.read.parquet(str(tmp_path / "unknown/v=1")).first().transaction_id == "none"
    table = lambda: versioned.read_parts(spark, tx.schema, [f for _, f in versioned.newest_parts(spark, path).values()])
    assert table().count() == 500 and table().where("status = 'DONE'").count() == 1
    # a batch that fails half-way leaves no finished version
    (tmp_path / "t/v=2/_part=3").mkdir(parents=True)
    assert versioned.newest_parts(spark, path) == after and table().count() == 500
    batch(spark.createDataFrame([("T8", "DONE", "C", 1, 1)], shape), 1)
    assert table().count() == 500 and table().where("status = 'DONE'").count() == 2


def test_refresh_that_fails_leaves_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerloom.sources import sinks, versioned

    path = str(tmp_path / "t")
    sinks.refresh(spark.range(5), path)
    try:
        sinks.refresh(spark.range(9).select(F.when(F.col("id") > 4, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    except Exception as e:
        assert "stop" in str(e)
    else:
        raise AssertionError("it went on")
    assert versioned.latest(spark, path).count() == 5
    sinks.refresh(spark.range(3), path)
    assert versioned.latest(spark, path).count() == 3


def test_a_bad_amount_rejects_its_file_alone(spark, tmp_path):
    for name, text in (("a", "A,1\nB,2\n"), ("b", "C,3\nD,x\n"), ("c", "A,5\nE,6\n")):
        (tmp_path / f"{name}.csv").write_text("transaction_id,amount\n" + text)
    good, bad = ingest.ingest(ingest.read_csv(spark, str(tmp_path)), "ledger", by_file=True)
    assert {r.transaction_id: r.amount for r in good.collect()} == {"A": 1.0, "B": 2.0, "E": 6.0}
    assert sorted((r.transaction_id, r.reason) for r in bad.collect()) == [("A", "duplicate_in_file"), ("C", "bad_file"), ("D", "bad_amount")]


def test_only_folders_of_the_range_are_read(spark, tmp_path):
    from ledgerloom.operators import logs

    rows = spark.range(200).selectExpr("id as seq", "concat('d', id % 3) as dfsp", "timestamp_seconds(id * 3600) as log_time", "'p' as path")
    logs.write_log(rows, str(tmp_path))
    got = logs.log_range(spark.read.parquet(str(tmp_path)), "d1", "1970-01-05 00:00:00", "1970-01-04 00:00:00")
    assert [r.seq for r in got.collect()] == [i for i in range(72, 96) if i % 3 == 1]
    scan = next(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    kept = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dfsp" in kept and "day" in kept


def test_numbers_as_in_rules(spark):
    from pyspark.sql import functions as F

    texts = {"0x10": 16.0, "0XfF": 255.0, "0b101": 5.0, "0o17": 15.0, "0x": None, "-0x1": None, "0xg": None, " \t7\n": 7.0, "1e3": 1000.0, "": 0.0, "true": 1.0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ms.as_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts


def test_limits_of_each_environment(spark):
    rules = [{"conditions": {"all": [{"fact": "amount", "operator": "numericGreaterThan", "value": "{$environment.limit}"}, {"fact": "kind", "operator": "equal", "value": "{$environment.kind}"}]}, "event": {"type": "OVER"}}]
    m = spark.createDataFrame([(1, "a", 50.0, "x"), (2, "b", 50.0, "x"), (3, "c", 50.0, "x"), (4, "a", 50.0, "y"), (5, None, 50.0, "x")], "seq int, env string, amount double, kind string")
    p = spark.createDataFrame([("a", "limit", "0x20"), ("a", "kind", "x"), ("b", "limit", "60"), ("b", "kind", "x"), ("c", "kind", "x")], "env string, name string, value string")
    assert {r.seq: r.event for r in rail.classify_bound(m, rules, p, "env").collect()} == {1: "OVER", 2: None, 3: None, 4: None, 5: None}


def test_history_that_expires(spark, tmp_path):
    """A batch writes its own rows alone; minutes that are over are gone from the disk; equal to the batch form."""
    rows = lambda *x: spark.createDataFrame(x, "seq long, s long").selectExpr("seq", "timestamp_seconds(s) as ts")
    path, batch = str(tmp_path / "h"), feeds.keep_recent(str(tmp_path / "h"))
    sent = [rows((1, 0), (2, 59), (3, 601), (4, None)), rows((5, 640), (6, 30)), rows((7, 1241)), rows((8, 1300), (9, 9000))]
    so_far = None
    for n, part in enumerate(sent):
        batch(part, n)
        so_far = part if so_far is None else so_far.unionByName(part)
        want = sorted(r.seq for r in ms.retained(so_far).collect())
        assert sorted(r.seq for r in feeds.recent(spark, path, part.schema).collect()) == want
        batch(part, n)  # once more, as after a failure
        assert sorted(r.seq for r in feeds.recent(spark, path, part.schema).collect()) == want
    assert [p for p, _ in feeds.all_parts(spark, path)] == [150] and feeds.versions(spark, path) == [4]
    empty = feeds.keep_recent(str(tmp_path / "e"))
    empty(rows((1, 1)).limit(0), 0)
    assert feeds.recent(spark, str(tmp_path / "e"), sent[0].schema).count() == 0


def test_first_of_each_key_without_a_table(spark, tmp_path):
    def send(n, *rows):
        spark.createDataFrame(rows, "k string, s long, n int").selectExpr("k", "timestamp_seconds(s) as ts", "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        first = feeds.first_within(spark.readStream.schema("k string, ts timestamp, n int").parquet(str(tmp_path / "in")), "k", "ts", "1 minute")
        first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r.n) for r in spark.read.schema("k string, ts timestamp, n int").parquet(str(tmp_path / "out")).collect())

    assert send(1, ("a", 100, 1), ("b", 110, 2)) == [("a", 1), ("b", 2)]
    assert send(2, ("a", 120, 3), ("c", 1000, 4)) == [("a", 1), ("b", 2), ("c", 4)]
    # the state of a is gone, so a later row of it is new; one behind the watermark is dropped
    assert send(3, ("a", 1001, 5), ("d", 130, 6)) == [("a", 1), ("a", 5), ("b", 2), ("c", 4)]


def test_callbacks_keep_open_listeners_over_batches(spark, tmp_path):
    """Many listeners of one path: each gets the first callback from its time on; state is freed once the watermark has passed."""
    at = lambda rows: spark.createDataFrame(rows, "id long, s double").selectExpr("id", "'put' as method", "'/hot' as path", "cast(s as timestamp) as ts")
    asked, heard = at([(i, 100 + i / 10) for i in range(300)]), at([(i, 100 + 3.0 * i) for i in range(12)] + [(99, 5000.0)])  # from 1970 on: watermarks start there
    asked.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "l"))
    heard.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "i"))
    read = lambda d, df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / d)).withColumnRenamed("id", name)
    q = feeds.await_callbacks(read("l", asked, "listener"), read("i", heard, "seq"), 2).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = rail.await_callbacks(asked.withColumnRenamed("id", "listener"), heard.withColumnRenamed("id", "seq"), 2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(tuple, want.collect()))
    join = next(o for o in q.lastProgress["stateOperators"] if "Join" in o["operatorName"])
    assert join["numRowsTotal"] <= 1


def test_tables_of_a_database(spark):
    from pyspark.sql import functions as F

    from ledgerloom.sources.payments import from_database

    url, driver = "jdbc:derby:memory:ledger;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    t = payments(spark, SF, "transactions").select("seq", "transaction_id", "payer", "amount")
    t = t.unionByName(t.limit(1).withColumn("seq", F.lit(None).cast("long")))
    t.write.format("jdbc").options(url=url, dbtable="transactions", driver=driver).mode("overwrite").save()
    got = from_database(spark, url, "transactions", "seq", 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(str, got.collect())) == sorted(map(str, t.collect()))
    few = got.where("seq < 100 and payer like 'B%'").select("transaction_id")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(seq,100)" in plan.replace("*", "") and "amount" not in plan.split("Scan")[1]
    assert few.count() == t.where("seq < 100 and payer like 'B%'").count()
    t.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", driver=driver).mode("overwrite").save()
    assert from_database(spark, url, "nothing", "seq", 4, driver=driver).count() == 0


def test_exposure_takes_numbers_and_stays_exact(spark, tmp_path):
    """A provider's messages are held as numbers, whatever their amounts: none, negative, with many digits."""
    from decimal import Decimal

    amounts = [None, -0.000000001, 1.1, 123456789012.123456, -987654321.5, 4e18, 1e-9, 0.1, -4e18, 999999999.999999999]
    rows = [(i, f"2024-01-01 00:00:{i % 7:02d}", "post", "/transfers" if i % 3 else "/quotes", "f", amounts[i % 10]) for i in range(90)]
    m = spark.createDataFrame(rows, "seq long, ts string, method string, path string, payee_fsp string, amount double").selectExpr("seq", "cast(ts as timestamp) as ts", "method", "path", "payee_fsp", "amount")
    assert {t for c, t in feeds.exposure_numbers(m).dtypes if c not in ("payee_fsp", "ts")} == {"bigint", "int", "double", "boolean"}
    got = collected(feeds.exposure(stream_of(spark, m, str(tmp_path / "in"))), spark, "numbers", tmp_path)
    used, want = Decimal(0), {}
    for i, _, _, path, _, amount in sorted(rows, key=lambda r: (r[1], r[0])):
        if path == "/quotes":
            want[i] = 1000.0 - float(used)
        else:
            used += Decimal(repr(amount or 0.0)).quantize(Decimal("1e-9"))
    assert {r[0]: r[3] for r in got} == want


def test_a_stream_of_a_large_table_has_files_that_one_task_can_sort(spark, monkeypatch):
    from ledgerloom.plans import feeds_and_files

    monkeypatch.setattr(feeds_and_files, "ROWS", 100, raising=False)
    rows = feeds_and_files.arriving(spark.range(1000), "id")
    from ledgerloom.steps import written

    assert len(spark.read.parquet(written()[-1]).inputFiles()) >= 10 and rows.isStreaming
