"""Queries over logs and nested test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(t: Column, as_of: str, gte: str | None, lt: str | None, back: str) -> Column:
    """From ``gte``, or so long before ``as_of``, until before ``lt``, or ``as_of``."""
    now = F.to_timestamp(F.lit(as_of))
    return (t >= (F.to_timestamp(F.lit(gte)) if gte else now - F.expr(f"interval {back}"))) & (t < (F.to_timestamp(F.lit(lt)) if lt else now))


def write_log(logs: DataFrame, path: str) -> None:
    """Append to a log table (dfsp, log_time, ...) in folders by provider and day."""
    logs.withColumn("day", F.to_date("log_time")).write.mode("append").partitionBy("dfsp", "day").parquet(path)


def log_range(logs: DataFrame, dfsp: str, as_of: str, gte: str | None = None, lt: str | None = None) -> DataFrame:
    """A provider's log of the last hour, or from ``gte`` until before ``lt``, ascending. Of a table in folders only those of
    the provider and the days are read."""
    rows = logs.where((F.col("dfsp") == dfsp) & between(F.col("log_time"), as_of, gte, lt, "1 hour"))
    if "day" in logs.columns:
        now = F.to_date(F.lit(as_of))
        rows = rows.where(F.col("day").between(F.to_date(F.lit(gte)) if gte else F.date_sub(now, 1), F.to_date(F.lit(lt)) if lt else now)).drop("day")
    return rows.orderBy("log_time", "seq")


def report_range(reports: DataFrame, as_of: str, gte: str | None = None, lt: str | None = None) -> DataFrame:
    """Reports completed in the last 30 days, or from ``gte`` until before ``lt``, descending."""
    return reports.where(between(F.col("completed"), as_of, gte, lt, "30 days")).orderBy(F.desc("completed"), "report_id")


def report_listing(reports: DataFrame, first: str, last: str, passed: bool | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of the reports completed from first to last, newest first, with the number of all."""
    t = F.col("completed")
    rows = reports.where((t >= F.to_timestamp(F.lit(first))) & (t <= F.to_timestamp(F.lit(last))))
    if passed is not None:
        rows = rows.where(F.col("is_passed") == passed)
    page = rows.orderBy(F.desc("completed"), "report_id").offset(skip).limit(limit)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def search_key(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    return rows.where(F.col(key).cast("string").rlike("(?i)" + pattern))


def service_logs(hits: DataFrame, equal: dict[str, str], page: int = 20) -> DataFrame:
    """Hits that have all the given values at dotted paths, without trace events, the first page by time."""
    keep = F.coalesce(F.col("metadata.event.type") != "trace", F.lit(True))
    for path, value in equal.items():
        keep = keep & (F.col(path) == value)
    trace = "metadata.trace"
    out = hits.where(keep).orderBy(f"{trace}.startTimestamp", "seq").limit(page)
    return out.select("seq", f"{trace}.service", F.col(f"{trace}.startTimestamp").alias("timestamp"), f"{trace}.tags.source", f"{trace}.tags.destination", F.col("metadata.event.state.status").alias("status"), "content")


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + of(x).cast("long"))


def asserted(request: Column) -> Column:
    """Number of a request's assertions, 0 where the list is missing."""
    return F.coalesce(F.size(request["tests"]["assertions"]), F.lit(0))


def failed(request: Column) -> Column:
    """A missing list isn't a failure; a list without a count of passed ones is."""
    tests = request["tests"]
    return tests["assertions"].isNotNull() & F.coalesce(tests["passedAssertionsCount"] != F.size(tests["assertions"]), F.lit(True))


def rollup(reports: DataFrame) -> DataFrame:
    """Counts per report, within the row: no shuffle."""
    cases = F.coalesce("test_cases", F.array().cast(reports.schema["test_cases"].dataType))
    empty = F.array().cast(reports.schema["test_cases"].dataType.elementType["requests"].dataType)
    requests = F.flatten(F.transform(cases, lambda c: F.coalesce(c["requests"], empty)))
    passed = lambda r: F.coalesce(r["tests"]["passedAssertionsCount"], F.lit(0))
    rows = reports.withColumns({"_cases": cases, "_requests": requests})
    r, c = F.col("_requests"), F.col("_cases")
    out = rows.withColumns({"total_assertions": total(r, asserted), "passed_assertions": total(r, passed)})
    return out.select(
        *reports.columns, "total_assertions", "passed_assertions", (F.col("total_assertions") - F.col("passed_assertions")).alias("failed_assertions"),
        F.size(c).cast("long").alias("n_cases"), total(c, lambda x: F.coalesce(F.exists(x["requests"], failed), F.lit(False)).cast("int")).alias("failed_cases"),
        F.size(r).cast("long").alias("n_requests"), total(r, lambda x: failed(x).cast("int")).alias("failed_requests"),
    )


def pass_percentage(request: Column) -> Column:
    """Rounded half up; 100 where the list is missing, null where it is empty."""
    n = F.size(request["tests"]["assertions"])
    share = F.floor(request["tests"]["passedAssertionsCount"] * 100 / F.nullif(n, F.lit(0)) + 0.5)
    return F.when(request["tests"]["assertions"].isNull(), F.lit(100).cast("long")).otherwise(share)


def verdict(rolled: DataFrame) -> DataFrame:
    """Whether all assertions passed, and the duration in milliseconds."""
    took = F.unix_millis(F.col("completed").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))
    return rolled.withColumns({"is_passed": F.col("passed_assertions") == F.col("total_assertions"), "duration_ms": took})


def counters(judged: DataFrame) -> DataFrame:
    """Passed and failed reports and assertions by template."""
    n = lambda c: F.count_if(c)
    return judged.groupBy("template").agg(n(F.col("is_passed")).alias("passed"), n(~F.col("is_passed")).alias("failed"), F.sum("passed_assertions").alias("assertions_passed"), F.sum("failed_assertions").alias("assertions_failed"))


def assertion_counters(reports: DataFrame) -> DataFrame:
    """Passed and failed assertions by the request's description and the test case's name."""
    rows = reports.select(F.explode("test_cases").alias("c")).select(F.col("c.name").alias("test"), F.explode("c.requests").alias("r"))
    n, ok = asserted(F.col("r")), F.coalesce("r.tests.passedAssertionsCount", F.lit(0))
    return rows.groupBy(F.col("r.description").alias("request"), "test").agg(F.sum(ok.cast("long")).alias("assert_success"), F.sum((n - ok).cast("long")).alias("assert_fail"))
