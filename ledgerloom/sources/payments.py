"""Payment tables derived from the order tables, as Spark SQL that DuckDB runs too (with
``varchar`` for ``string``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCY = "case o_orderkey % 4 when 0 then 'USD' when 1 then 'INR' when 2 then 'EUR' else 'KES' end"
REF = "case when o_orderkey % 50 = 49 then cast(null as string) {pad} else concat('REF-', o_orderkey) end"
BUYER = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
TABLES = {
    "transactions_base": f"""select o_orderkey as seq, concat('TX-', o_orderkey) as transaction_id, {REF.format(pad="")} as reference_id,
 concat(c_mktsegment, ' ', n_name) as payer, s_name as payee, concat('FSP-', o_custkey % 7) as payer_fsp, concat('FSP-', o_orderkey % 5) as payee_fsp,
 o_totalprice as amount, {CURRENCY} as currency, 'SUCCESS' as status, 'COMMITTED' as transfer_state, o_orderdate as created_at
 from {BUYER} join supplier on s_suppkey = o_orderkey % 10""",
    "transactions": """select * from transactions_base union all
 select seq + 1000000000 as seq, concat('TX-D-', seq) as transaction_id, concat('REF-D-', seq) as reference_id, payer, payee, payer_fsp, payee_fsp, amount,
 currency, status, transfer_state, created_at from transactions_base where seq % 100 = 1""",
    "bank_transactions": f"""select o_orderkey as seq, concat('BS-', o_orderkey) as bank_statement_id, concat('ACC-', o_custkey) as account_number,
 case when o_orderkey % 10 = 7 then 'CLEARING HOUSE' when o_orderkey % 6 = 0 then concat(c_mktsegment, ' ', n_name, ' Ltd') else concat(c_mktsegment, ' ', n_name) end as counterparty,
 case when o_orderkey % 10 = 7 then o_totalprice * 0.5 else o_totalprice end as amount, {CURRENCY} as currency, 'CREDIT' as transaction_type,
 {REF.format(pad="when o_orderkey % 9 = 0 then concat(' REF-', o_orderkey, ' ')")} as reference_number, o_orderdate as value_date
 from {BUYER} where o_orderkey % 20 <> 3""",
    "erp_records": f"""select o_orderkey as seq, concat('ERP-', o_orderkey) as erp_id, concat('REF-', o_orderkey) as invoice_number, s_name as customer_vendor_name,
 o_totalprice as expected_amount, {CURRENCY} as currency, o_orderdate as posting_date
 from orders join supplier on s_suppkey = o_orderkey % 10 where o_orderkey % 40 not in (3, 27)""",
    "messages": """select event_id as seq, ts, case event_type when 'view' then 'get' when 'error' then 'put' else 'post' end as method,
 case event_type when 'signup' then '/quotes' when 'purchase' then '/transfers' when 'view' then concat('/transfers/', user_id) when 'click' then '/fxTransfers' else concat('/quotes/', user_id, '/error') end as path,
 concat('T', user_id) as transaction_id, concat('fsp', user_id % 5) as payee_fsp, value as amount from events""",
    "rail": """select seq, ts, method, path, transaction_id, payee_fsp, amount,
 concat('application/vnd.interoperability.', case when seq % 5 = 0 then 'iso20022.' else '' end, 'transfers+json;version=2.0') as content_type,
 concat('00-', md5(cast(seq as string)), '-b7ad6b7169203331-01') as traceparent,
 case seq % 3 when 0 then concat('{"transferId":"', transaction_id, '"}') when 1 then concat('{"transferId":"","commitRequestId":"C', seq, '"}')
 else concat('{"CdtTrfTxInf":{"PmtId":{"TxId":"Q', seq, '","EndToEndId":"', transaction_id, '"},"IntrBkSttlmAmt":{"Ccy":"USD","ActiveCurrencyAndAmount":"', seq % 1000, '"},"CdtrAgt":{"FinInstnId":{"Othr":{"Id":"', payee_fsp,
 '"}}},"DbtrAgt":{"FinInstnId":{"Othr":{"Id":"hub"}}},"Cdtr":{"Id":{"OrgId":{"Othr":{"Id":"BUSINESS","SchmeNm":{"Prtry":"', seq, '"}}}}},"Dbtr":{"Id":{"PrvtId":{"Othr":{"Id":"MSISDN","SchmeNm":{"Prtry":"', seq % 97, '"}}}}}}}') end as body from messages""",
}
BASE = ("orders", "customer", "nation", "supplier", "events")
#: Derived tables that others are made of.
FROM = {"transactions": "transactions_base", "rail": "messages"}


def payments(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table, planned lazily from the Parquet files of ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", TABLES[name])}
    if name in FROM:
        frames[FROM[name]] = payments(spark, sf_dir, FROM[name])
    named = re.sub(rf"\b({'|'.join(frames)})\b(?=\s|$)", r"{\1}", TABLES[name].replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **frames)


def with_tables(select: str, *names: str) -> str:
    """DuckDB SQL: the select over the derived tables that it names, or over those given, after which it may go on to define
    tables of its own."""
    need = set(names) or {n for n in TABLES if re.search(rf"\b{n}\b", select)}
    need |= {FROM[n] for n in need if n in FROM}
    return "with " + ",\n".join(f"{n} as ({sql.replace('as string', 'as varchar')})" for n, sql in TABLES.items() if n in need) + (",\n" if names else "\n") + select


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested test reports: a customer's orders as test cases, their lines as requests with up to three assertions."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber") % 4
    assertions = F.transform(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), n), lambda x: F.struct(x.alias("exec")))
    passed = F.least(n, (F.floor("l_quantity") % 4).cast("int"))
    tests = F.when(F.col("l_linenumber") % 7 != 0, F.struct(passed.alias("passedAssertionsCount"), assertions.alias("assertions")))
    cases = lines.groupBy("o_custkey", "l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("description"), tests.alias("tests"))).alias("requests"), F.min("o_orderdate").alias("d"))
    return cases.groupBy(F.col("o_custkey").alias("report_id")).agg(F.concat(F.lit("template-"), (F.first("o_custkey") % 5).cast("string")).alias("template"), F.min("d").alias("started"), F.max("d").alias("completed"), F.collect_list(F.struct(F.concat(F.lit("case-"), (F.col("l_orderkey") % 10).cast("string")).alias("name"), "requests")).alias("test_cases"))


def from_database(spark: SparkSession, url: str, table: str, key: str, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read by ``parts`` connections in ranges of a key of whole numbers, or by one if it has no rows or no keys.
    Columns and filters of later steps go to the database. Rows without key are in the first range."""
    named = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    ends = reader.option("query", f"select min({named}) as lo, max({named}) as hi from {table}").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
    if ends[0] is None:
        return reader.load()
    # the upper bound is exclusive in the strides alone: no row is left out
    return reader.option("partitionColumn", key).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1] + 1)).option("numPartitions", str(parts)).load()


#: DuckDB SQL of the same reports, flat: one row per request.
REQUESTS = """requests as (select o_custkey as report_id, concat('template-', o_custkey % 5) as template, l_orderkey, o_orderdate, concat('line-', l_linenumber) as description, concat('case-', l_orderkey % 10) as name, case when l_linenumber % 7 <> 0 then l_linenumber % 4 end as n,
 case when l_linenumber % 7 <> 0 then least(l_linenumber % 4, cast(floor(l_quantity) as bigint) % 4) end as p from lineitem join orders on l_orderkey = o_orderkey),
rolled as (select report_id, any_value(template) as template, min(o_orderdate) as started, max(o_orderdate) as completed, cast(sum(coalesce(n, 0)) as bigint) as total_assertions, cast(sum(coalesce(p, 0)) as bigint) as passed_assertions,
 cast(sum(coalesce(n, 0)) - sum(coalesce(p, 0)) as bigint) as failed_assertions, count(distinct l_orderkey) as n_cases, count(distinct case when p <> n then l_orderkey end) as failed_cases, count(*) as n_requests, count(case when p <> n then 1 end) as failed_requests
 from requests group by report_id)"""
