"""Reports and exports of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versioned import publish

#: The report's columns.
REPORT = ("transaction_id", "ledger_id", "ledger_type", "status", "amount_difference", "match_confidence", "confidence_tier", "remarks")


def report_rows(results: DataFrame, status: str | None = None) -> DataFrame:
    """The report's columns in ledger order, nulls as empty text."""
    rows = results if status is None else results.where(F.col("status") == status)
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in results.columns else F.lit("").alias(c) for c in REPORT]
    return rows.select("seq", *have).orderBy("seq")


def write_report(results: DataFrame, path: str, status: str | None = None) -> None:
    report_rows(results, status).drop("seq").write.mode("overwrite").option("header", True).csv(path)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table, and the counts of all tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    counts(tables).write.mode("overwrite").json(f"{path}/metadata")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def refresh(results: DataFrame, path: str) -> None:
    """Replace the stored results by a new version; a second run gives the same table, and one that fails leaves the version
    before. ``versioned.latest`` reads it."""
    publish(results, path)
