"""Registered queries that run a stream to its end over files, or write files and read them again, with the SQL of the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import logs as lg
from ..operators import rail as rl
from ..sources import ingest as ig
from ..sources import sinks
from ..sources.payments import payments, with_tables
from ..sources.versioned import latest, newest_parts, read_parts
from ..steps import scratch
from ..streaming import feeds

AS_OF = "2001-08-01"
DAY = 24 * 3600
#: Rows of a file that a stream reads.
ROWS = 250_000
LOG_TIME = "2024-01-20 12:00:00"


def arriving(df: DataFrame, *order: str, files: int = 3) -> DataFrame:
    """A stream of the rows, from files in the given order: that many, or more, so that a task never sorts much more than ROWS."""
    path = scratch(df.sparkSession)
    if order:
        files = max(files, -(-df.count() // ROWS))
    (df.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else df).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(rows: DataFrame) -> DataFrame:
    """What a stream puts out in all."""
    spark = rows.sparkSession
    out = scratch(spark)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def run(rows: DataFrame, batch: Callable[[DataFrame, int], None]) -> None:
    feeds.start(rows, batch, scratch(rows.sparkSession)).awaitTermination()


def bodies(t: DataFrame) -> DataFrame:
    """Transfers as JSON messages, each seventh twice with another amount; some without payer, with a text for amount, or no JSON."""
    n = F.col("seq")
    text = F.concat(
        F.lit('{"transactionId":"'), "transaction_id", F.when(n % 11 == 0, '"').otherwise(F.concat(F.lit('","payer":"'), "payer", F.lit('"'))), F.lit(',"payee":"'), "payee", F.lit('","payerFsp":"'), "payer_fsp", F.lit('","payeeFsp":"'), "payee_fsp",
        F.lit('","amount":'), F.when(n % 13 == 0, '"many"').otherwise(F.col("amount").cast("string")), F.when(n % 17 == 0, "").otherwise("}"),
    )
    rows = t.select("seq", F.lit(0).alias("turn"), text.alias("value"))
    again = t.where("seq % 7 = 0").select("seq", F.lit(1).alias("turn"), F.regexp_replace(text, '"amount":[0-9.]+', '"amount":1.5').alias("value"))
    return rows.unionByName(again)


def s7_transfers(spark, sf_dir: str) -> DataFrame:
    """The feed's table: the first message of each id, without those that are rejected."""
    table, dead = scratch(spark), scratch(spark)
    sent = bodies(payments(spark, sf_dir, "transactions"))
    # the repeats come in a later batch
    for turn in (0, 1):
        run(arriving(sent.where(F.col("turn") == turn).select("seq", "value")), feeds.checked_feed(table, f"{dead}/{turn}", parts=16))
    return spark.read.parquet(table).select("transaction_id", "payer", "payee", "amount", "currency", "transfer_state", "status")


def s7_rejected(spark, sf_dir: str) -> DataFrame:
    table, dead = scratch(spark), scratch(spark)
    run(arriving(bodies(payments(spark, sf_dir, "transactions")).where("turn = 0").select("seq", "value")), feeds.checked_feed(table, dead, parts=16))
    return spark.read.parquet(f"{dead}/v=*").groupBy("reason").agg(F.count("*").alias("n"))


def t1_feed(spark, sf_dir: str) -> DataFrame:
    """Batches with repeats: a stored row stays as it is."""
    table = scratch(spark)
    t = payments(spark, sf_dir, "transactions").select("seq", "transaction_id", "amount", "currency")
    for rows in (t.where("seq % 3 = 0"), t.withColumn("amount", F.lit(0.0)), t):
        run(arriving(rows), feeds.append_new(table, parts=16))
    return spark.read.parquet(table).select("transaction_id", "amount", "currency")


def t1_within(spark, sf_dir: str) -> DataFrame:
    """Each transfer twice, an hour apart: one of them enters."""
    t = payments(spark, sf_dir, "transactions").select("transaction_id", F.col("created_at").cast("timestamp").alias("created_at"), "amount")
    sent = t.unionByName(t.withColumn("created_at", F.col("created_at") + F.expr("interval 1 hour")))
    return drained(feeds.first_within(arriving(sent, "created_at"), "transaction_id", "created_at", "1 day")).select("transaction_id", "amount")


def t2_states(spark, sf_dir: str) -> DataFrame:
    t = payments(spark, sf_dir, "transactions").select("seq", "transaction_id", "status", "transfer_state")
    table, change = scratch(spark), F.col("seq") % 17 == 0
    sent = t.where(change).select("transaction_id", F.lit("FAILED").alias("status"), F.lit("ABORTED").alias("transfer_state"), F.current_timestamp().alias("ts"), "seq")
    ids = sent.withColumn("transaction_id", F.when(F.col("seq") % 2 == 1, F.concat("transaction_id", F.lit("-X"))).otherwise(F.col("transaction_id")))
    batch = feeds.state_updates(table, t, parts=16)
    run(arriving(ids), batch)
    return read_parts(spark, t.schema, [folder for _, folder in newest_parts(spark, table).values()])


def t4_associate(spark, sf_dir: str) -> DataFrame:
    return drained(feeds.associate(arriving(payments(spark, sf_dir, "messages"), "ts", "seq"), 24 * 60))


def t5_history(spark, sf_dir: str) -> DataFrame:
    table, m = scratch(spark), payments(spark, sf_dir, "messages")
    run(arriving(m, "ts", "seq"), feeds.keep_recent(table))
    return feeds.recent(spark, table, m.schema).select("seq", "path")


def t6_exposure(spark, sf_dir: str) -> DataFrame:
    """Some transfers have no amount, which counts as nothing."""
    m = payments(spark, sf_dir, "messages").withColumn("amount", F.when((F.col("seq") % 19 != 0) | (F.col("path") != "/transfers"), F.col("amount")))
    return drained(feeds.exposure(arriving(m, "ts", "seq")))


def t7_await(spark, sf_dir: str) -> DataFrame:
    """A last message, days later, tells those that still wait that nothing came."""
    m = payments(spark, sf_dir, "messages").select("seq", "ts", "method", "path", "transaction_id")
    asked = m.where("method = 'post' and path = '/quotes'").select(F.col("seq").alias("listener"), F.lit("put").alias("method"), F.concat(F.lit("/quotes/"), F.substring("transaction_id", 2, 20), F.lit("/error")).alias("path"), "ts")
    end = m.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(F.lit(-1).cast("long").alias("seq"), "ts", F.lit("get").alias("method"), F.lit("/end").alias("path"))
    heard = m.drop("transaction_id").unionByName(end)
    return drained(feeds.await_callbacks(arriving(asked, "ts", "listener"), arriving(heard, "ts", "seq"), DAY, methods=("put",)))


def a3_daily_stream(spark, sf_dir: str) -> DataFrame:
    """Daily sums of the stream, a last transfer of nothing closing the days before, on the calendar of the forecast."""
    t = payments(spark, sf_dir, "transactions").select(F.col("created_at").cast("timestamp").alias("created_at"), "amount")
    end = t.agg((F.max("created_at") + F.expr("interval 3 days")).alias("created_at"), F.lit(0.0).alias("amount"))
    sums = drained(fc.flow_stream(arriving(t.unionByName(end), "created_at"))).select(F.col("day").cast("timestamp").alias("created_at"), "amount")
    return fc.daily_flow(sums, AS_OF).select("idx", "day", F.round("amount", 2).alias("amount"))


def k2_export(spark, sf_dir: str) -> DataFrame:
    """Tables as JSON lines, read again."""
    path = scratch(spark)
    names = ("transactions", "bank_transactions", "erp_records")
    sinks.export_json({n: payments(spark, sf_dir, n) for n in names}, path)
    out = spark.read.json(f"{path}/metadata").select("table_name", "n")
    amount = {"erp_records": "expected_amount"}
    sums = None
    for n in names:
        one = spark.read.json(f"{path}/{n}").agg(F.lit(n).alias("table_name"), F.round(F.sum(amount.get(n, "amount")), 2).alias("total"))
        sums = one if sums is None else sums.unionByName(one)
    return out.join(sums, "table_name")


def k3_refresh(spark, sf_dir: str) -> DataFrame:
    """Twice the same refresh: the newest version is the table."""
    path, b = scratch(spark), payments(spark, sf_dir, "bank_transactions").select("seq", "bank_statement_id", "amount")
    for _ in range(2):
        sinks.refresh(b, path)
    return latest(spark, path)


def uploaded(t: DataFrame) -> DataFrame:
    """Three files; the amounts of one are spoilt here and there."""
    n = F.col("seq")
    amount = F.when((n % 3 == 2) & (n % 11 == 0), "n/a").otherwise(F.col("amount").cast("string"))
    return t.select("transaction_id", "payer", amount.alias("amount"), F.struct(F.concat(F.lit("file-"), (n % 3).cast("string")).alias("file"), n.alias("row")).alias("_place"))


def p3_ids(spark, sf_dir: str) -> DataFrame:
    """Made ids and references of rows without: all different, and the same when made again."""
    raw = payments(spark, sf_dir, "transactions").select(F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("transaction_id")).alias("transaction_id"), "amount", F.struct(F.lit("f").alias("file"), F.col("seq").alias("row")).alias("_place"))
    rows, again = (ig.ingest(raw, "ledger", batch="b")[0] for _ in range(2))
    made = F.col("transaction_id").rlike("^TX-[0-9A-F]{16}$")
    same = rows.select("transaction_id").join(again.select("transaction_id"), "transaction_id", "left_semi").agg(F.count("*").alias("same"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("transaction_id").alias("ids"), F.count_if(made).alias("made"), F.count_if(F.col("reference_id").rlike("^REF-[0-9A-F]{16}$")).alias("references")).join(same)


def s5_router(spark, sf_dir: str) -> DataFrame:
    """Uploads by the source's and the file's name."""
    t, b, e = (payments(spark, sf_dir, n) for n in ("transactions", "bank_transactions", "erp_records"))
    sheet = b.select(F.col("bank_statement_id").alias("Statement ID"), F.col("amount").alias("Amount"))
    out = None
    for source, file, raw in (("HUB", "a.csv", t.select("transaction_id", "amount")), (None, None, t.select("transaction_id", "amount")), ("Settlement", "b.XLSX", sheet), ("invoice", "c.csv", e.select("erp_id", "amount" if "amount" in e.columns else "expected_amount"))):
        kind, profile = ig.route(source, file)
        amount = "expected_amount" if kind == "erp" else "amount"
        one = ig.ingest(raw, kind, profile)[0].agg(F.lit(f"{source}/{file}").alias("upload"), F.lit(kind).alias("kind"), F.lit(profile).alias("profile"), F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def logged(spark, sf_dir: str) -> DataFrame:
    """The log, written in folders by provider and day."""
    path = scratch(spark)
    lg.write_log(payments(spark, sf_dir, "messages").select("seq", F.col("payee_fsp").alias("dfsp"), F.col("ts").alias("log_time"), "path"), path)
    return spark.read.parquet(path)


LIMITS = [
    {"conditions": {"all": [{"fact": "amount", "operator": "numericGreaterThan", "value": "{$environment.limit}"}, {"fact": "path", "operator": "includesString", "value": "{$environment.watched}"}]}, "event": {"type": "OVER_LIMIT"}},
    {"conditions": {"any": [{"fact": "path", "operator": "equal", "value": "{$environment.barred}"}]}, "event": {"type": "BARRED"}},
]


def m3_by_table(spark, sf_dir: str) -> DataFrame:
    """Each provider with limits of its own, from the nations' table: a provider's number is a nation's."""
    of = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 4").withColumn("payee_fsp", F.concat(F.lit("fsp"), F.col("n_nationkey").cast("string")))
    named = lambda name, value: of.select("payee_fsp", F.lit(name).alias("name"), value.cast("string").alias("value"))
    parameters = named("limit", F.col("n_nationkey") * 10).unionByName(named("watched", F.lit("uotes"))).unionByName(named("barred", F.lit("/fxTransfers")).where("payee_fsp <> 'fsp1'"))
    return rl.classify_bound(payments(spark, sf_dir, "messages"), LIMITS, parameters, "payee_fsp").select("seq", "event")


TABLE = lambda name, f: lambda s, d: f(payments(s, d, name))
QUERIES = {
    "s7_transfers": s7_transfers, "s7_rejected": s7_rejected, "t1_feed": t1_feed, "t1_within": t1_within, "t2_states": t2_states, "t4_associate": t4_associate, "t5_history": t5_history, "t6_exposure": t6_exposure, "t7_await": t7_await, "a3_daily_stream": a3_daily_stream,
    "k2_export": k2_export, "k3_refresh": k3_refresh, "p3_ids": p3_ids, "s5_router": s5_router, "m3_by_table": m3_by_table,
    "p2_whole_files": TABLE("transactions", lambda t: ig.ingest(uploaded(t), "ledger", by_file=True)[0].select("transaction_id", "payer", "amount")),
    "p2_rejected_files": TABLE("transactions", lambda t: ig.ingest(uploaded(t), "ledger", by_file=True)[1].select("transaction_id", "reason")),
    "l1_last_hour": lambda s, d: lg.log_range(logged(s, d), "fsp2", LOG_TIME).select("seq", "path"),
    "l1_partitioned": lambda s, d: lg.log_range(logged(s, d), "fsp1", LOG_TIME, "2024-01-18 06:00:00").select("seq", "path"),
}


def oracles(known: dict[str, str], fresh: str) -> dict[str, str]:
    """known: SQL of the batch forms."""
    sent = "select *, case when seq % 17 = 0 then 'no JSON object' when seq % 11 = 0 then 'missing: payer' when seq % 13 = 0 then 'amount is no number' end as reason from transactions"
    return {
        "s7_transfers": with_tables(f"select transaction_id, payer, payee, amount, 'USD' as currency, 'COMMITTED' as transfer_state, 'SUCCESS' as status from ({sent}) where reason is null"),
        "s7_rejected": with_tables(f"select reason, count(*) as n from ({sent}) where reason is not null group by reason"),
        "t1_feed": with_tables("select transaction_id, case when seq % 3 = 0 then amount else 0.0 end as amount, currency from transactions"),
        "t1_within": with_tables("select transaction_id, amount from transactions"),
        "t2_states": with_tables("select seq, transaction_id, case when seq % 34 = 0 then 'FAILED' else status end as status, case when seq % 34 = 0 then 'ABORTED' else transfer_state end as transfer_state from transactions"),
        "t4_associate": known["m12_quote_association"],
        "t5_history": known["t5_retention"],
        "t6_exposure": known["m6_exposure"].replace("coalesce(cast(amount as decimal(28,9)), 0)", "case when seq % 19 = 0 then 0 else cast(amount as decimal(28,9)) end"),
        "t7_await": known["t7_await_callback"],
        "a3_daily_stream": known["a3_daily_flow"],
        "k2_export": with_tables("select 'transactions' as table_name, count(*) as n, round(sum(amount), 2) as total from transactions union all select 'bank_transactions', count(*), round(sum(amount), 2) from bank_transactions union all select 'erp_records', count(*), round(sum(expected_amount), 2) from erp_records"),
        "k3_refresh": with_tables("select seq, bank_statement_id, amount from bank_transactions"),
        "p3_ids": with_tables("select count(*) as n, count(*) as ids, count(case when seq % 5 = 0 then 1 end) as made, count(*) as \"references\", count(*) as same from transactions"),
        "s5_router": with_tables("select 'HUB/a.csv' as upload, 'ledger' as kind, 'csv' as profile, count(*) as n, round(sum(amount), 2) as total from transactions union all select 'None/None', 'ledger', 'csv', count(*), round(sum(amount), 2) from transactions union all select 'Settlement/b.XLSX', 'bank', 'sheet', count(*), round(sum(amount), 2) from bank_transactions union all select 'invoice/c.csv', 'erp', 'csv', count(*), round(sum(expected_amount), 2) from erp_records"),
        "m3_by_table": with_tables("select seq, case when payee_fsp <> 'fsp4' and amount > cast(substr(payee_fsp, 4) as integer) * 10 and contains(path, 'uotes') then 'OVER_LIMIT' when payee_fsp not in ('fsp4', 'fsp1') and path = '/fxTransfers' then 'BARRED' end as event from messages"),
        "p2_whole_files": with_tables("select transaction_id, payer, amount from transactions where seq % 3 <> 2"),
        "p2_rejected_files": with_tables("select transaction_id, case when seq % 11 = 0 then 'bad_amount' else 'bad_file' end as reason from transactions where seq % 3 = 2"),
        "l1_last_hour": with_tables(f"select seq, path from messages where payee_fsp = 'fsp2' and ts >= timestamp '{LOG_TIME}' - interval 1 hour and ts < timestamp '{LOG_TIME}'"),
        "l1_partitioned": with_tables(f"select seq, path from messages where payee_fsp = 'fsp1' and ts >= timestamp '2024-01-18 06:00:00' and ts < timestamp '{LOG_TIME}'"),
    }
