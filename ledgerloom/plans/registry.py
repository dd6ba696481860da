"""Registered queries over the derived payment tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import PER_USD, formatted, to_usd
from ..operators import forecast as fc
from ..operators import messages as ms
from ..operators import rail as rl
from ..operators import logs as lg
from ..operators import reconcile as rc
from ..operators import updates as up
from ..sources import ingest as ig
from ..sources import sinks
from ..sources.payments import REQUESTS, payments, reports, with_tables

AS_OF = "2001-08-01"
RULES = [
    {"conditions": {"all": [{"fact": "method", "operator": "equal", "value": "post"}, {"fact": "path", "operator": "equal", "value": "/quotes"}, {"fact": "amount", "operator": "numericGreaterThan", "value": 100}]}, "event": {"type": "LARGE_QUOTE"}},
    {"conditions": {"any": [{"fact": "path", "operator": "includesString", "value": "/error"}, {"fact": "method", "operator": "in", "value": ["put", "patch"]}]}, "event": {"type": "CALLBACK"}},
    {"conditions": {"all": [{"fact": "path", "operator": "includesString", "value": "ransfers"}]}, "event": {"type": "TRANSFER"}},
]


def tables(*names):
    return lambda f: lambda s, d: f(*(payments(s, d, n) for n in names))


LEDGERS = ("transactions", "bank_transactions", "erp_records")
found = lambda t, b, e: rc.anomalies(rc.reconcile(t, b, e))
results = lambda t, b, e: rc.reconcile(t, b, e).select(*rc.RESULT)

QUERIES = {
    "p4_fx": tables("transactions")(lambda t: t.select("seq", F.round(to_usd(F.col("amount"), F.col("currency")), 6).alias("usd"))),
    "w1_duplicates": tables("transactions")(lambda t: rc.duplicate_charges(t).select("seq", "transaction_id", "previous_id")),
    "j6_reconcile": tables(*LEDGERS)(results),
    "o3_anomalies": tables(*LEDGERS)(found),
    "o1_anomaly_queue": tables(*LEDGERS)(lambda t, b, e: rc.anomaly_queue(found(t, b, e))),
    "a1_dashboard": tables(*LEDGERS)(lambda t, b, e: rc.dashboard(rc.reconcile(t, b, e))),
    "p12_result_filter": tables(*LEDGERS)(lambda t, b, e: rc.where_status(results(t, b, e), "partial", "medium")),
    "p13_queue": tables(*LEDGERS)(lambda t, b, e: rc.queue(results(t, b, e), "bs-1", True)),
    "a3_daily_flow": tables("transactions")(lambda t: fc.daily_flow(t, AS_OF).select("idx", "day", F.round("amount", 2).alias("amount"))),
    "a5_forecast": tables("transactions")(lambda t: fc.forecast(fc.daily_flow(t, AS_OF), AS_OF)),
    "m1_classification": tables("messages")(lambda m: ms.classify(m, RULES).select("seq", "event")),
    "m6_exposure": tables("messages")(ms.exposure),
    "m9_callbacks": tables("messages")(ms.callbacks),
    "t5_retention": tables("messages")(lambda m: ms.retained(m).select("seq", "path")),
}

_RATE = "case currency when 'INR' then 83.5::double when 'EUR' then 0.92::double when 'KES' then 129.5::double else 1.0::double end"
ORACLES = {
    "p4_fx": with_tables(f"select seq, round(amount / {_RATE}, 6) as usd from transactions"),
    "w1_duplicates": with_tables("select seq, transaction_id, previous_id from (select seq, transaction_id, row_number() over w as rn, first(transaction_id) over w as previous_id from transactions window w as (partition by payer, amount, currency order by seq)) where rn > 1"),
    "a3_daily_flow": with_tables(f"select cast(i as integer) as idx, cast(date '{AS_OF}' - 30 + cast(i as integer) as date) as day, round(coalesce((select sum(amount) from transactions where cast(created_at as date) = date '{AS_OF}' - 30 + cast(i as integer)), 0), 2) as amount from range(30) r(i)"),
    "m1_classification": with_tables("select seq, case when method = 'post' and path = '/quotes' and amount > 100 then 'LARGE_QUOTE' when contains(path, '/error') or method in ('put', 'patch') then 'CALLBACK' when contains(path, 'ransfers') then 'TRANSFER' end as event from messages"),
    "m9_callbacks": with_tables("select base_path, seq, is_error from (select regexp_replace(path, '/error$', '') as base_path, seq, path like '%/error' as is_error, row_number() over (partition by regexp_replace(path, '/error$', '') order by ts desc, seq desc) as rn from messages where method = 'put') where rn = 1"),
    "m6_exposure": with_tables("select seq, payee_fsp, amount, allowed, case when amount > allowed then '5100' end as error from (select *, 1000.0::double - coalesce(sum(case when path = '/transfers' then coalesce(cast(amount as decimal(28,9)), 0) else 0 end) over (partition by payee_fsp order by ts, seq rows between unbounded preceding and 1 preceding), 0)::double as allowed from messages where method = 'post' and path in ('/quotes', '/transfers')) where path = '/quotes'"),
    "t5_retention": with_tables("select seq, path from messages where ts >= (select max(ts) from messages) - interval 10 minutes"),
}


def ledger_file(t):
    """An uploaded ledger with sheet headers, blank payers, bad amounts and repeated rows."""
    n = F.col("seq")
    raw = lambda d: d.select(F.col("transaction_id").alias("Transaction ID"), F.when(n % 7 == 0, "").otherwise(F.col("payer")).alias("payer"), F.concat(F.lit("Alt "), "payer").alias("Payer Name"), F.when(n % 11 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"), "currency")
    return ig.ingest(raw(t).unionByName(raw(t.where(n % 100 == 1))), "ledger", existing=t.where(n % 13 == 0))


def bank_file(b, profile):
    names = {"csv": ("bank_statement_id", "counterparty", "amount", "ref_id"), "sheet": ("Statement ID", "Payer", "Amount", "Reference Number")}[profile]
    raw = b.select(*(F.col(c).cast("string").alias(a) for c, a in zip(("bank_statement_id", "counterparty", "amount", "reference_number"), names, strict=True)))
    return ig.ingest(raw, "bank", profile)[0]


def erp_file(e):
    raw = e.select("erp_id", "invoice_number", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("expected_amount").cast("string")).alias("expected_amount"), F.col("expected_amount").alias("amount"))
    return ig.ingest(raw, "erp")[0]


def quotes(m):
    """Quote requests as JSON, each fifth without payee and each third with an amount type."""
    party = lambda name, who: f'"{name}":{{"fspId":"{who}"}},'
    body = F.concat(
        F.lit('{"quoteId":"Q'), "seq", F.lit('","transactionId":"'), "transaction_id", F.lit('",' + party("payer", "hub")), F.when(F.col("seq") % 5 == 0, "").otherwise(party("payee", "x")),
        F.when(F.col("seq") % 3 == 0, '"amountType":"RECEIVE",').otherwise(""), F.lit('"amount":{"currency":"USD","amount":"'), (F.col("seq") % 100).cast("string"), F.lit('"},"transactionType":{"scenario":"TRANSFER"}}'),
    )
    return m.where("method = 'post'").select("seq", body.alias("body"))


def rivals(t, b, e):
    """Few references for many rows: tens of transfers, bank rows and invoices share one and compete for the same ledger rows."""
    few = lambda df, ref: df.withColumn(ref, F.when(F.col("seq") % 50 == 49, F.lit(None)).otherwise(F.concat(F.lit("R"), F.floor(F.col("seq") / 48).cast("string"))))
    return rc.reconcile(few(t, "reference_id"), few(b, "reference_number"), few(e, "invoice_number")).select(*rc.RESULT)


def service_hits(m):
    trace = F.struct(F.col("payee_fsp").alias("service"), F.col("ts").alias("startTimestamp"), F.struct(F.col("method").alias("source"), F.col("path").alias("destination")).alias("tags"))
    event = F.struct(F.when(F.col("seq") % 4 == 0, "trace").otherwise("log").alias("type"), F.struct(F.when(F.col("seq") % 3 == 0, "failed").otherwise("success").alias("status")).alias("state"))
    return m.select("seq", F.struct(trace.alias("trace"), event.alias("event")).alias("metadata"), F.col("transaction_id").alias("content"))


def forwarded(m):
    """Messages with a header of their sender, routed by it, and by method and path."""
    rows = m.withColumn("headers", F.create_map(F.lit("fspiop-source"), F.concat(F.lit("dfsp"), (F.col("seq") % 4).cast("string")), F.lit("date"), F.lit("x")))
    return rows.select("seq", rl.forward_to(rows, ROUTES).alias("dfsp"))


_SENT_BY = lambda who, *more: {"all": [{"fact": "headers", "operator": "equal", "value": who, "path": "fspiop-source"}, *more]}
ROUTES = [
    {"conditions": _SENT_BY("dfsp1", {"fact": "method", "operator": "equal", "value": "get"}), "event": {"type": "FORWARD", "params": {"to": "payee", "dfspId": "hub"}}},
    {"conditions": _SENT_BY("dfsp1", {"fact": "path", "operator": "includesString", "value": "fx"}), "event": {"type": "FORWARD", "params": {"to": "payee", "dfspId": "fxp1"}}},
    {"conditions": _SENT_BY("dfsp2"), "event": {"type": "MOCK", "params": {"dfspId": "none"}}},
    {"conditions": {"any": [{"fact": "headers", "operator": "notEqual", "value": "dfsp3", "path": "fspiop-source"}, {"fact": "path", "operator": "equal", "value": "/transfers"}]}, "event": {"type": "FORWARD", "params": {"to": "payer", "dfspId": "fsp2"}}},
]
LIMITED = [{"conditions": {"all": [{"fact": "amount", "operator": "numericGreaterThan", "value": "{$environment.limit}"}]}, "event": {"type": "OVER_LIMIT"}}]
OPERATORS = [
    {"conditions": {"all": [{"fact": "body", "path": "CdtTrfTxInf.IntrBkSttlmAmt.ActiveCurrencyAndAmount", "operator": "numberStringGreaterThanInclusive", "value": 500}, {"fact": "method", "operator": "notIn", "value": ["get", "put"]}]}, "event": {"type": "LARGE_ISO", "params": {"delay": 5}}},
    {"conditions": {"all": [{"fact": "body", "path": "commitRequestId", "operator": "includesString", "value": "7"}, {"fact": "amount", "operator": "lessThanInclusive", "value": 40}]}, "event": {"type": "COMMIT_7"}},
    {"conditions": {"any": [{"fact": "headers", "path": "accept", "operator": "includesString", "value": "iso20022"}, {"fact": "body", "path": "transferId", "operator": "equal", "value": "T5"}]}, "event": {"type": "ISO_OR_T5"}},
    {"conditions": {"all": [{"fact": "amount", "operator": "numericNotEqual", "value": "12"}, {"fact": "path", "operator": "excludesString", "value": "fx"}, {"fact": "amount", "operator": "greaterThan", "value": 60}]}, "event": {"type": "OTHER"}},
]
ENDPOINTS = [{"method": "put", "path": "/quotes/{ID}/error", "endpoint": "http://errors"}, {"method": "get", "path": "/transfers/{ID}", "endpoint": "http://transfers"}]
BY_FSP = {"fsp3": {"endpoints": [{"method": "post", "path": "/any", "endpoint": "http://fsp3/post"}], "default": "http://fsp3"}}
RANGE = ("2024-01-05 00:00:00", "2024-01-07 12:00:00")
REPORTED = ("1996-01-01 00:00:00", "2001-07-01 00:00:00")
judged = lambda s, d: lg.verdict(lg.rollup(reports(s, d))).drop("test_cases")
listeners = lambda m: m.where("method = 'post' and path = '/quotes'").select(F.col("seq").alias("listener"), F.lit("put").alias("method"), F.concat(F.lit("/quotes/"), F.substring("transaction_id", 2, 20), F.lit("/error")).alias("path"), "ts")
manual = lambda r: r.where("seq % 10 = 3").select("transaction_id", F.lit("BS-MANUAL").alias("ledger_id"), F.lit("ERP").alias("ledger_type"), F.lit("By hand").alias("remarks"))
updates = lambda t: t.where("seq % 17 = 0").select(F.when(F.col("seq") % 2 == 0, F.col("transaction_id")).otherwise(F.concat("transaction_id", F.lit("-X"))).alias("transaction_id"), F.lit("FAILED").alias("status"), F.lit("ABORTED").alias("transfer_state"), F.col("created_at").alias("ts"), "seq")
iso = lambda m: m.select("seq", rl.iso_transfer(F.col("body")).alias("x")).where("x.transaction_id is not null").select("seq", "x.*")
headers = lambda: F.create_map(F.lit("Content-Type"), F.col("content_type"), F.lit("accept"), F.col("content_type"), F.lit("date"), F.lit("x"))

QUERIES |= {
    "s1_ledger_file": tables("transactions")(lambda t: ledger_file(t)[0].select("transaction_id", "payer", "payee", "amount", "currency", "status")),
    "w4_rejects": tables("transactions")(lambda t: ledger_file(t)[1].select("transaction_id", "reason")),
    "s2_bank_file": tables("bank_transactions")(lambda b: bank_file(b, "csv")),
    "s4_bank_sheet": tables("bank_transactions")(lambda b: bank_file(b, "sheet")),
    "s3_erp_file": tables("erp_records")(erp_file),
    "k1_report": tables(*LEDGERS)(lambda t, b, e: sinks.report_rows(results(t, b, e), "partial")),
    "j7_matched_value": tables(*LEDGERS)(lambda t, b, e: rc.matched_value(results(t, b, e), t)),
    "j3_low_candidates": tables(*LEDGERS)(lambda t, b, e: results(t, b, e).where("match_confidence <= 80").drop("remarks")),
    "o2_listing": tables("transactions")(lambda t: rc.listing(t, "transactions").select("seq", "transaction_id")),
    "j9_resolved": tables(*LEDGERS)(lambda t, b, e: (lambda r: up.resolve_anomalies(rc.anomalies(r), manual(r)).select("seq", "anomaly_type", "status"))(rc.reconcile(t, b, e))),
    "j6_rivals": tables(*LEDGERS)(lambda t, b, e: rivals(t, b, e).drop("remarks")),
    "s4_erp_sheet": tables("erp_records")(lambda e: ig.ingest(e.select(F.col("erp_id").alias("ERP ID"), F.col("invoice_number").alias("Invoice Number"), F.col("expected_amount").cast("string").alias("Amount"), F.col("currency").alias("Currency")), "erp", "sheet")[0]),
    "s8_requests": tables("messages")(lambda m: ig.checked_requests(quotes(m))[0].select("seq", "quoteId", F.col("payer")["fspId"].alias("payer_fsp"), F.col("amount")["amount"].alias("amount"), "amountType")),
    "s8_rejected": tables("messages")(lambda m: ig.checked_requests(quotes(m))[1].select("seq", "reason")),
    "m2_operators": tables("rail")(lambda m: ms.classify(m.withColumn("headers", headers()), OPERATORS).select("seq", "event", "event_params")),
    "p5_rates": tables("transactions")(lambda t: up.add_rates(t.groupBy(F.col("currency").alias("from_currency")).agg(F.lit("USD").alias("to_currency"), F.lit(1.0).alias("rate")).where("from_currency <> 'INR' and from_currency <> 'EUR'"), PER_USD)),
    "l9_assertions": lambda s, d: lg.assertion_counters(reports(s, d)),
    "a7_export_counts": tables(*LEDGERS)(lambda t, b, e: sinks.counts({"transactions": t, "bank_transactions": b, "erp_records": e})),
    "a2_run_summary": tables(*LEDGERS)(lambda t, b, e: rc.run_summary(rc.reconcile(t, b, e))),
    "a6_forecast_totals": tables("transactions")(lambda t: up.forecast_totals(fc.forecast(fc.daily_flow(t, AS_OF), AS_OF))),
    "p14_bands": tables(*LEDGERS)(lambda t, b, e: results(t, b, e).select("seq", up.status_kind(F.col("status")).alias("kind"), up.status_label(F.col("status")).alias("label"), up.confidence_band(F.col("match_confidence")).alias("band"))),
    "p15_lookup": tables("transactions")(lambda t: up.lookup(t, "TX-D-1").select("seq", "transaction_id").unionByName(up.lookup(t, "20").select("seq", "transaction_id"))),
    "p16_delete": tables("transactions")(lambda t: up.without(t, t.where("seq % 3 = 0"), "transaction_id").select("seq", "transaction_id")),
    "p17_formatted": tables("transactions")(lambda t: t.select("seq", formatted(F.col("amount"), F.col("currency")).alias("shown"))),
    "p18_dates": tables("transactions")(lambda t: t.select("seq", F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("moment"))),
    "j9_manual_match": tables(*LEDGERS)(lambda t, b, e: (lambda r: up.manual_match(r, manual(r)))(results(t, b, e))),
    "j10_state_update": tables("transactions")(lambda t: up.update_states(t, updates(t))[0].select("seq", "status", "transfer_state")),
    "j10_not_found": tables("transactions")(lambda t: up.update_states(t, updates(t))[1]),
    "m3_bound_rules": tables("messages")(lambda m: ms.classify(m, rl.bind(LIMITED, {"limit": 25})).select("seq", "event")),
    "m4_forward": tables("messages")(forwarded),
    "m5_endpoint": tables("messages")(lambda m: m.select("seq", rl.endpoint(F.col("method"), F.col("path"), F.col("payee_fsp"), "http://default", ENDPOINTS, BY_FSP).alias("endpoint"))),
    "m7_iso_transfer": tables("rail")(iso),
    "m8_iso_headers": tables("rail")(lambda m: m.select("seq", rl.rewritten(headers(), F.col("method"), F.col("path")).alias("h")).select("seq", F.col("h")["Content-Type"].alias("content_type"), F.col("h")["accept"].alias("accept"), F.col("h")["date"].alias("date_header"))),
    "m10_transfer_id": tables("rail")(lambda m: m.select("seq", rl.transfer_id(F.col("body")).alias("transfer_id"), rl.transfer_kind(F.col("path")).alias("kind"))),
    "m11_trace_id": tables("rail")(lambda m: m.select("seq", rl.trace_id(F.col("traceparent")).alias("trace_id"))),
    "m12_quote_association": tables("messages")(lambda m: rl.associate_quotes(m, 24 * 60)),
    "m13_stored_transfer": tables("messages")(lambda m: rl.stored_transfers(m, 24 * 60)),
    "t7_await_callback": tables("messages")(lambda m: rl.await_callbacks(listeners(m), m, 24 * 3600)),
    "l1_log_range": tables("messages")(lambda m: lg.log_range(m.select("seq", F.col("payee_fsp").alias("dfsp"), F.col("ts").alias("log_time"), "path"), "fsp2", RANGE[1], *RANGE).select("seq", "path")),
    "l2_report_range": lambda s, d: lg.report_range(judged(s, d), REPORTED[1], *REPORTED).select("report_id"),
    "l3_report_listing": lambda s, d: lg.report_listing(judged(s, d), *REPORTED, passed=False, skip=2, limit=5).select("report_id", "total"),
    "l4_key_search": tables("transactions")(lambda t: lg.search_key(t, "transaction_id", "^tx-d-.*1$").select("seq", "transaction_id")),
    "l5_service_logs": tables("messages")(lambda m: lg.service_logs(service_hits(m), {"metadata.trace.service": "fsp2", "metadata.event.state.status": "failed"}).drop("timestamp")),
    "l6_rollup": lambda s, d: judged(s, d).select("report_id", "total_assertions", "passed_assertions", "failed_assertions", "n_cases", "failed_cases", "n_requests", "failed_requests"),
    "l7_pass_percentage": lambda s, d: reports(s, d).select("report_id", F.explode("test_cases").alias("c")).select("report_id", F.explode("c.requests").alias("r")).select("report_id", lg.pass_percentage(F.col("r")).alias("percentage")).groupBy("report_id", "percentage").agg(F.count("*").alias("n")),
    "l8_verdict": lambda s, d: judged(s, d).select("report_id", "is_passed", "duration_ms"),
    "l9_counters": lambda s, d: lg.counters(judged(s, d)),
}

_USD = lambda c: f"{c} / {_RATE}"
_CAP = lambda x: f"case when round({x}, 2) > 100 then 100 else round({x}, 2) end"
_PLACES = "list_sum(list_transform(range(1, greatest(length(a.w), 1) + 1), lambda i: case when substr(a.w, cast(i as integer), 1) = c then cast(1 as bigint) << cast(i - 1 as integer) else 0 end))"
_COMMON = f"60 - bit_count(list_reduce(list_transform(list_filter(string_split(b.w, ''), lambda c: c <> ''), lambda c: cast({_PLACES} as bigint)), lambda s, m: ((s + (s & m)) | (s - (s & m))) & 1152921504606846975, cast(1152921504606846975 as bigint)))"
_SORTED = "array_to_string(list_sort(string_split(lower(n), ' ')), ' ')"
#: The ledgers and name scores.
_LEDGERS = f"""t as (select seq, transaction_id, payer, payee, amount, currency, {_USD("amount")} as usd, case when reference_id <> '' then trim(reference_id) end as key, case when row_number() over w > 1 then first(transaction_id) over w end as previous_id from transactions window w as (partition by payer, amount, currency order by seq)),
l as (select 'BANK' as side, seq as l_seq, bank_statement_id as ledger_id, counterparty as name, {_USD("amount")} as l_usd, case when reference_number <> '' then trim(reference_number) end as key from bank_transactions
 union all select 'ERP', seq, erp_id, customer_vendor_name, {_USD("expected_amount")}, case when invoice_number <> '' then trim(invoice_number) end from erp_records),
wt as (select n, {_SORTED} as w from (select payer as n from t union select payee from t)),
wl as (select n, {_SORTED} as w from (select distinct name as n from l)),
sims as (select a.n as n, b.n as name, case when a.w = b.w then 100.0::double else (1 - (length(a.w) + length(b.w) - 2 * ({_COMMON})) / cast(length(a.w) + length(b.w) as double)) * 100 end as score from wt a, wl b)"""
_RAW = "(case when side = 'BANK' then greatest(x.score, y.score) else y.score end) * 0.4::double + greatest(0.0::double, 100 - abs(usd - l_usd) / (usd + 1e-5) * 100) * 0.4::double"
_SIMS = "join sims x on x.n = payer and x.name = l.name join sims y on y.n = payee and y.name = l.name"


def _pick(source: str) -> str:
    """The best bank row and invoice per transfer of pairs, and which of them is the result."""
    best = f"select seq, side, arg_max({{'ledger_id': ledger_id, 'raw': raw, 'gap': gap}}, {{'s': {_CAP('raw')}, 'a': raw > {_CAP('raw')}, 'n': case when raw > {_CAP('raw')} then l_seq else -l_seq end}}) as x from {source} group by seq, side"
    both = f"select seq, any_value(x) filter (where side = 'BANK') as b, any_value(x) filter (where side = 'ERP') as e from ({best}) group by seq"
    held = f"coalesce({_CAP('b.raw')}, 0)"
    named = f"select *, case when {held} < 85 and coalesce(e.raw > {held}, false) then 'ERP' when b.raw > 0 then 'BANK' end as ledger_type from ({both})"
    of = lambda c: f"case ledger_type when 'ERP' then e.{c} when 'BANK' then b.{c} end as {c}"
    return f"select seq, ledger_type, {of('ledger_id')}, {of('raw')}, {of('gap')} from ({named})"


#: The results over unique references: what they decide, and all pairs of the rest.
_RESULTS = f"""{_LEDGERS},
near as (select seq, side, l_seq, ledger_id, {_RAW} + 40 as raw, abs(usd - l_usd) as gap from t join l using (key) {_SIMS}),
decided as materialized (select * from ({_pick("near")}) where raw > 80),
open_rows as (select l.*, d.seq as taken_at from l left join decided d on d.ledger_type = l.side and d.ledger_id = l.ledger_id and {_CAP("d.raw")} >= 90),
far as (select t.seq, side, l_seq, ledger_id, {_RAW} as raw, abs(usd - l_usd) as gap from (select * from t where seq not in (select seq from decided)) t join open_rows l on l.taken_at is null or l.taken_at >= t.seq {_SIMS}),
own as (select near.* from near join open_rows l using (side, ledger_id) where near.seq not in (select seq from decided) and (l.taken_at is null or l.taken_at >= near.seq)),
pairs as (select * from far union all select * from own),
picked as (select * from decided union all select * from ({_pick("pairs")})),
scored as (select t.*, coalesce(p.ledger_type, 'BANK') as ledger_type, p.ledger_id, coalesce({_CAP("p.raw")}, 0) as match_confidence, coalesce(round(p.gap, 2), 0) as amount_difference from t left join picked p using (seq)),
graded as materialized (select *, case when match_confidence >= 90 then 'matched' when match_confidence >= 70 then 'partial' else 'unmatched' end as status, case when match_confidence >= 90 then 'high' when match_confidence >= 70 then 'medium' else 'low' end as confidence_tier from scored),
results as (select seq, transaction_id, ledger_id, ledger_type, status, amount_difference, match_confidence, confidence_tier, case status when 'matched' then concat('Automated AI High-Confidence Match against ', ledger_type, ' ledger record ''', ledger_id, '''.')
 when 'partial' then concat('Partial Match against ', ledger_type, ' ledger record ''', ledger_id, '''. Slight amount difference of ', amount_difference, ' USD or name variance.') else 'No matching bank statement or ERP invoice record found within acceptable confidence threshold.' end as remarks from graded),
found as (select seq, transaction_id, 'duplicate_charge' as anomaly_type, 'high' as severity, 0.92::double as risk_score, concat('Potential duplicate charge detected. Identical amount ', currency, ' ', amount, ' and payer ''', payer, ''' matches previous transaction ''', previous_id, '''.') as explanation, 'OPEN' as status from graded where previous_id is not null
 union all select seq, transaction_id, 'amount_mismatch', 'medium', 0.55::double, concat('Amount difference of $', amount_difference, ' USD between Mojaloop transaction (', currency, ' ', amount, ') and ledger record ''', ledger_id, '''.'), 'OPEN' from graded where status = 'partial'
 union all select seq, transaction_id, 'missing_settlement', 'high', 0.88::double, concat('Mojaloop transfer of ', currency, ' ', amount, ' has no matching settlement record in central bank or ERP ledgers.'), 'OPEN' from graded where status = 'unmatched')"""


def _of_results(select: str) -> str:
    return with_tables(f"{_RESULTS} {select}", "transactions", "bank_transactions", "erp_records")


_FORECAST = f"""flow as (select cast(i as integer) as idx, coalesce((select sum(amount) from transactions where cast(created_at as date) = date '{AS_OF}' - 30 + cast(i as integer)), 0) as amount from range(30) r(i)),
line as (select regr_sxy(amount, idx) / (regr_sxx(amount, idx) + 1) as slope, avg(amount) as my, avg(idx) as mx from flow), fit as (select slope, my - slope * mx as intercept from line),
dev as (select stddev_pop(amount - slope * idx - intercept) as std from flow, fit),
days as (select cast(date '{AS_OF}' + 1 + cast(k as integer) as date) as forecast_date, slope * (30 + k) + intercept as x, std from range(7) r(k), fit, dev),
pred as (select forecast_date, std, round(greatest(1000, case when isodow(forecast_date) >= 6 then x * 0.65::double else x end), 2) as p from days),
forecast as (select forecast_date, p as predicted_amount, round(greatest(0, p - 1.96::double * std), 2) as lower_bound, round(p + 1.96::double * std, 2) as upper_bound, round(p * 1.25::double, 2) as inflow, round(p * 0.25::double, 2) as outflow from pred)"""
_POPPED = "select {cols} from (select *, lag(seq) over w as last_seq, lag(ts) over w as last_ts, lag(is_push) over w as last_push from (select seq, ts, transaction_id, ({push}) as is_push from messages where ({push}) or ({pop})) window w as (partition by transaction_id order by ts, seq)) where not is_push"
_FRESH = "case when last_push and ts <= last_ts + interval 24 hours then last_seq end"
_REPORT = lambda select: f"with {REQUESTS} {select}"
ORACLES |= {
    "s1_ledger_file": with_tables("select transaction_id, case when seq % 7 = 0 then concat('Alt ', payer) else payer end as payer, 'Unknown Payee' as payee, amount, currency, 'SUCCESS' as status from transactions where seq % 11 <> 0 and seq % 13 <> 0"),
    "w4_rejects": with_tables("select transaction_id, case when seq % 11 = 0 then 'bad_amount' else 'duplicate_in_file' end as reason from (select * from transactions where seq % 11 = 0 union all select * from transactions where seq % 100 = 1)"),
    "s2_bank_file": with_tables("select bank_statement_id, 'ACC-10098' as account_number, counterparty, amount, 'USD' as currency, 'CREDIT' as transaction_type, reference_number from bank_transactions"),
    "s4_bank_sheet": with_tables("select bank_statement_id, 'ACC-10098' as account_number, counterparty, amount, 'USD' as currency, 'CREDIT' as transaction_type, coalesce(reference_number, '') as reference_number from bank_transactions"),
    "s3_erp_file": with_tables("select erp_id, invoice_number, 'Vendor Inc' as customer_vendor_name, expected_amount, 'USD' as currency, '1100-RECEIVABLES' as ledger_account from erp_records"),
    "a7_export_counts": with_tables("select 'transactions' as table_name, count(*) as n from transactions union all select 'bank_transactions', count(*) from bank_transactions union all select 'erp_records', count(*) from erp_records"),
    "p15_lookup": with_tables("select seq, transaction_id from transactions where transaction_id = 'TX-D-1' or seq = 20"),
    "p16_delete": with_tables("select seq, transaction_id from transactions where seq % 3 <> 0"),
    "p17_formatted": with_tables("select seq, concat(case currency when 'USD' then '$' when 'INR' then '₹' when 'EUR' then '€' else 'KSh' end, format('{:,.2f}', amount)) as shown from transactions"),
    "p18_dates": with_tables("select seq, strftime(created_at, '%Y-%m-%d') as day, strftime(created_at, '%Y-%m-%d %H:%M:%S') as moment from transactions"),
    "j10_state_update": with_tables("select seq, case when seq % 34 = 0 then 'FAILED' else status end as status, case when seq % 34 = 0 then 'ABORTED' else transfer_state end as transfer_state from transactions"),
    "j10_not_found": with_tables("select concat(transaction_id, '-X') as transaction_id, 'FAILED' as status, 'ABORTED' as transfer_state from transactions where seq % 34 = 17"),
    "m3_bound_rules": with_tables("select seq, case when amount > 25 then 'OVER_LIMIT' end as event from messages"),
    "m4_forward": with_tables("select seq, case when seq % 4 = 1 and method = 'get' then 'hub' when seq % 4 = 1 and contains(path, 'fx') then 'fxp1' when seq % 4 <> 3 or path = '/transfers' then 'fsp2' end as dfsp from messages"),
    "m5_endpoint": with_tables("select seq, case when payee_fsp = 'fsp3' then case when method = 'post' then 'http://fsp3/post' else 'http://fsp3' end when method = 'put' and regexp_matches(path, '/quotes/.*/error') then 'http://errors' when method = 'get' and regexp_matches(path, '/transfers/.*') then 'http://transfers' else 'http://default' end as endpoint from messages"),
    "m7_iso_transfer": with_tables("select seq, transaction_id, concat('Q', seq) as quote_id, 'BUSINESS' as payee_id_type, cast(seq as varchar) as payee_identifier, payee_fsp, 'MSISDN' as payer_id_type, cast(seq % 97 as varchar) as payer_identifier, 'hub' as payer_fsp, 'USD' as currency, cast(seq % 1000 as varchar) as amount from messages where seq % 3 = 2"),
    "m8_iso_headers": with_tables("select seq, replace(content_type, 'interoperability.', 'interoperability.iso20022.') as content_type, replace(content_type, 'interoperability.', 'interoperability.iso20022.') as accept, 'x' as date_header from rail"),
    "m10_transfer_id": with_tables("select seq, case seq % 3 when 0 then transaction_id when 1 then concat('C', seq) else concat('Q', seq) end as transfer_id, case when contains(path, '/fxTransfers') then 'fxTransfer' when contains(path, '/transfers') then 'transfer' end as kind from messages"),
    "m11_trace_id": with_tables("select seq, md5(cast(seq as varchar)) as trace_id from messages"),
    "m12_quote_association": with_tables(_POPPED.format(cols=f"seq, {_FRESH} as quote_seq, case when {_FRESH} is null then '3208' end as error", push="method = 'post' and path = '/quotes'", pop="method = 'post' and path = '/transfers'")),
    "m13_stored_transfer": with_tables(_POPPED.format(cols=f"seq, {_FRESH} as transfer_seq", push="method = 'post' and path = '/transfers'", pop="method = 'get' and path like '/transfers/%'")),
    "t7_await_callback": with_tables("select l.seq as listener, arg_min(i.seq, {'ts': i.ts, 'seq': i.seq}) as callback_seq from messages l left join messages i on i.method = 'put' and i.path = concat('/quotes/', substr(l.transaction_id, 2), '/error') and i.ts >= l.ts and i.ts <= l.ts + interval 24 hours where l.method = 'post' and l.path = '/quotes' group by l.seq"),
    "l1_log_range": with_tables(f"select seq, path from messages where payee_fsp = 'fsp2' and ts >= timestamp '{RANGE[0]}' and ts < timestamp '{RANGE[1]}'"),
    "l2_report_range": _REPORT(f"select report_id from rolled where completed >= timestamp '{REPORTED[0]}' and completed < timestamp '{REPORTED[1]}'"),
    "l3_report_listing": _REPORT(f"select report_id, count(*) over () as total from rolled where completed between timestamp '{REPORTED[0]}' and timestamp '{REPORTED[1]}' and passed_assertions <> total_assertions order by completed desc, report_id limit 5 offset 2"),
    "l4_key_search": with_tables("select seq, transaction_id from transactions where regexp_matches(transaction_id, '^tx-d-.*1$', 'i')"),
    "l5_service_logs": with_tables("select seq, payee_fsp as service, method as source, path as destination, 'failed' as status, transaction_id as content from messages where payee_fsp = 'fsp2' and seq % 3 = 0 and seq % 4 <> 0 order by ts, seq limit 20"),
    "l6_rollup": _REPORT("select report_id, total_assertions, passed_assertions, failed_assertions, n_cases, failed_cases, n_requests, failed_requests from rolled"),
    "l7_pass_percentage": _REPORT("select report_id, case when n is null then 100 when n = 0 then null else cast(floor(p * 100.0 / n + 0.5) as bigint) end as percentage, count(*) as n from requests group by all"),
    "l8_verdict": _REPORT("select report_id, passed_assertions = total_assertions as is_passed, epoch_ms(completed) - epoch_ms(started) as duration_ms from rolled"),
    "l9_assertions": _REPORT("select description as request, name as test, cast(sum(coalesce(p, 0)) as bigint) as assert_success, cast(sum(coalesce(n, 0) - coalesce(p, 0)) as bigint) as assert_fail from requests group by 1, 2"),
    "l9_counters": _REPORT("select template, count(case when passed_assertions = total_assertions then 1 end) as passed, count(case when passed_assertions <> total_assertions then 1 end) as failed, cast(sum(passed_assertions) as bigint) as assertions_passed, cast(sum(failed_assertions) as bigint) as assertions_failed from rolled group by template"),
}

_TAKES = f"case when {_CAP('raw')} >= 90 then list_append(taken, concat(ledger_type, ledger_id)) else taken end"
_HELD = f"coalesce({_CAP('b.raw')}, 0)"
_BEST = f"arg_max({{'ledger_id': ledger_id, 'raw': raw, 'gap': gap}}, {{'s': {_CAP('raw')}, 'a': raw > {_CAP('raw')}, 'n': case when raw > {_CAP('raw')} then l_seq else -l_seq end}})"
#: One transfer of each reference a step, in order, with the list of ledger rows that those before have taken.
_TURNS = f"""ordered as (select seq, key, row_number() over (partition by key order by seq) as n from t where key is not null),
turns as (select distinct key, cast(0 as bigint) as n, cast([] as varchar[]) as taken, cast(null as bigint) as seq, cast(null as varchar) as ledger_type, cast(null as varchar) as ledger_id, cast(null as double) as raw, cast(null as double) as gap from ordered
 union all select key, n, {_TAKES}, seq, ledger_type, ledger_id, raw, gap from (select key, n, taken, seq, ledger_type, case ledger_type when 'ERP' then e.ledger_id when 'BANK' then b.ledger_id end as ledger_id, case ledger_type when 'ERP' then e.raw when 'BANK' then b.raw end as raw, case ledger_type when 'ERP' then e.gap when 'BANK' then b.gap end as gap
 from (select *, case when {_HELD} < 85 and coalesce(e.raw > {_HELD}, false) then 'ERP' when b.raw > 0 then 'BANK' end as ledger_type
 from (select key, n, taken, seq, any_value(x) filter (where side = 'BANK') as b, any_value(x) filter (where side = 'ERP') as e
 from (select o.key, o.n, taken, o.seq, near.side, {_BEST.replace("ledger_id", "near.ledger_id").replace("'near.ledger_id'", "'ledger_id'").replace("raw", "near.raw").replace("'near.raw'", "'raw'").replace("gap", "near.gap").replace("'near.gap'", "'gap'")} as x
 from turns join ordered o on o.key = turns.key and o.n = turns.n + 1 left join near on near.seq = o.seq and not list_contains(taken, concat(near.side, near.ledger_id)) group by all) group by all)))),"""


def _of_rivals(select: str) -> str:
    few = lambda ref: f"(case when seq % 50 <> 49 then concat('R', cast(floor(seq / 48) as bigint)) end)"
    out = _RESULTS
    for ref in ("reference_id", "reference_number", "invoice_number"):
        out = out.replace(f"case when {ref} <> '' then trim({ref}) end", few(ref))
    out = out.replace("decided as materialized", f"{_TURNS}\ndecided as materialized").replace(f"(select * from ({_pick('near')}) where raw > 80)", "(select seq, ledger_type, ledger_id, raw, gap from turns where raw > 80)")
    return with_tables(f"{out} {select}", "transactions", "bank_transactions", "erp_records").replace("with ", "with recursive ", 1)


_HAND = "seq % 10 = 3"
ORACLES |= {
    "j6_reconcile": _of_results("select * from results"),
    "j6_rivals": _of_rivals("select * exclude (remarks) from results"),
    "j3_low_candidates": _of_results("select * exclude (remarks) from results where match_confidence <= 80"),
    "j7_matched_value": _of_results("select round(sum(amount), 2) as total_reconciled_value from transactions where transaction_id in (select transaction_id from results where status = 'matched')"),
    "o3_anomalies": _of_results("select * from found"),
    "o1_anomaly_queue": _of_results("select * from found"),
    "a1_dashboard": _of_results("select count(*) as total_transactions, count(*) filter (where status = 'matched') as matched, count(*) filter (where status = 'partial') as partial, count(*) filter (where status = 'unmatched') as unmatched, round(count(*) filter (where status = 'matched') / cast(count(*) as double) * 100, 2) as match_rate, count(*) filter (where status <> 'matched') as mismatched, round(sum(amount) filter (where status = 'matched'), 2) as total_reconciled_value, (select count(*) from found) as open_anomalies from graded"),
    "a2_run_summary": _of_results("select count(*) as total_reconciled, count(*) filter (where status = 'matched') as matched_count, (select count(*) from found) as anomalies_detected, concat('AI Reconciliation complete. ', count(*) filter (where status = 'matched'), '/', count(*), ' matched successfully.') as message from results"),
    "p12_result_filter": _of_results("select * from results where status = 'partial' and confidence_tier = 'medium'"),
    "p13_queue": _of_results("select * from results where status = 'matched' and (contains(lower(transaction_id), 'bs-1') or contains(lower(remarks), 'bs-1') or contains(lower(coalesce(ledger_id, '')), 'bs-1'))"),
    "p14_bands": _of_results("select seq, status as kind, case status when 'matched' then 'Matched' when 'partial' then 'Partial / Fee discrepancy' else 'Unmatched' end as label, case when match_confidence >= 80 then 'high' when match_confidence >= 50 then 'mid' else 'low' end as band from results"),
    "k1_report": _of_results("select seq, transaction_id, coalesce(ledger_id, '') as ledger_id, ledger_type, status, cast(amount_difference as varchar) as amount_difference, cast(match_confidence as varchar) as match_confidence, confidence_tier, remarks from results where status = 'partial'"),
    "j9_manual_match": _of_results(f"select seq, transaction_id, case when {_HAND} then 'BS-MANUAL' else ledger_id end as ledger_id, case when {_HAND} then 'ERP' else ledger_type end as ledger_type, case when {_HAND} then 'matched' else status end as status, amount_difference, case when {_HAND} then 100 else match_confidence end as match_confidence, case when {_HAND} then 'high' else confidence_tier end as confidence_tier, case when {_HAND} then 'By hand' else remarks end as remarks from results"),
    "j9_resolved": _of_results(f"select seq, anomaly_type, case when {_HAND} then 'RESOLVED' else 'OPEN' end as status from found"),
    "o2_listing": with_tables("select seq, transaction_id from transactions order by seq desc"),
    "a5_forecast": with_tables(f"{_FORECAST} select * from forecast", "transactions"),
    "a6_forecast_totals": with_tables(f"{_FORECAST} select round(sum(inflow), 2) as inflow, round(sum(outflow), 2) as outflow, round(sum(predicted_amount), 2) as predicted_amount from forecast", "transactions"),
    "s4_erp_sheet": with_tables("select erp_id, invoice_number, 'Vendor Inc' as customer_vendor_name, expected_amount, currency, '1100-RECEIVABLES' as ledger_account from erp_records"),
    "s8_requests": with_tables("select seq, concat('Q', seq) as quoteId, 'hub' as payer_fsp, cast(seq % 100 as varchar) as amount, case when seq % 3 = 0 then 'RECEIVE' else 'SEND' end as amountType from messages where method = 'post' and seq % 5 <> 0"),
    "s8_rejected": with_tables("select seq, 'missing: payee' as reason from messages where method = 'post' and seq % 5 = 0"),
    "m2_operators": with_tables("select seq, event, case event when 'LARGE_ISO' then '{\"delay\": 5}' end as event_params from (select seq, case when seq % 3 = 2 and seq % 1000 >= 500 and method not in ('get', 'put') then 'LARGE_ISO' when seq % 3 = 1 and contains(cast(seq as varchar), '7') and amount <= 40 then 'COMMIT_7' when seq % 5 = 0 or (seq % 3 = 0 and transaction_id = 'T5') then 'ISO_OR_T5' when coalesce(amount <> 12, true) and not contains(path, 'fx') and amount > 60 then 'OTHER' end as event from rail)"),
    "p5_rates": with_tables("select currency as from_currency, 'USD' as to_currency, 1.0::double as rate from transactions where currency not in ('INR', 'EUR') group by currency union all select c, 'USD', 1 / r from (values ('INR', 83.5::double), ('EUR', 0.92::double), ('GBP', 0.78::double), ('TZS', 2680.0::double), ('UGX', 3720.0::double)) v(c, r)"),
}

from . import feeds_and_files  # noqa: E402

QUERIES |= feeds_and_files.QUERIES
ORACLES |= feeds_and_files.oracles(ORACLES, _FRESH)
