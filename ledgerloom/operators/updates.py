"""Changes to stored tables as joins: manual matches, state updates, deletions, rates, lookups, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manual_match(results: DataFrame, matches: DataFrame) -> DataFrame:
    """Results with the manual matches (transaction_id, ledger_id, and ledger_type, remarks, seq where given) set, added
    where there was no row. The amount difference stays, 0 for an added row. Of several matches of one transfer the one
    of the highest seq counts, or of the greatest ledger id. A type that is not given is BANK."""
    given = lambda c, default: F.coalesce(F.col(c), default) if c in matches.columns else default
    last = F.struct(F.col("seq") if "seq" in matches.columns else F.lit(0), "ledger_id")
    m = matches.groupBy("transaction_id").agg(F.max_by(F.struct("ledger_id", given("ledger_type", F.lit("BANK")).alias("ledger_type"), given("remarks", F.lit("")).alias("remarks")), last).alias("_m"))
    hit = F.col("_m").isNotNull()
    set_to = {"ledger_id": F.col("_m.ledger_id"), "ledger_type": F.col("_m.ledger_type"), "status": F.lit("matched"), "match_confidence": F.lit(100.0), "confidence_tier": F.lit("high"), "remarks": F.col("_m.remarks")}
    out = results.join(m, "transaction_id", "full_outer")
    columns = [F.when(hit, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.coalesce(c, F.lit(0.0)).alias(c) if c == "amount_difference" else F.col(c) for c in results.columns]
    return out.select(*columns)


def resolve_anomalies(anomalies: DataFrame, matches: DataFrame) -> DataFrame:
    """Open anomalies of the matched transfers become resolved."""
    m = matches.select("transaction_id", F.lit(True).alias("_hit")).distinct()
    done = F.col("_hit").isNotNull() & (F.col("status") == "OPEN")
    return anomalies.join(m, "transaction_id", "left").withColumn("status", F.when(done, "RESOLVED").otherwise(F.col("status"))).drop("_hit")


def update_states(tx: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfers with the new status and state, updates of unknown transfers). The last update of an id by
    (ts, seq) counts."""
    last = updates.groupBy("transaction_id").agg(F.max_by(F.struct("status", "transfer_state"), F.struct("ts", "seq")).alias("_u"))
    out = tx.join(last, "transaction_id", "left")
    known = out.select(*(F.coalesce(f"_u.{c}", c).alias(c) if c in ("status", "transfer_state") else F.col(c) for c in tx.columns))
    return known, last.join(tx.select("transaction_id"), "transaction_id", "left_anti").select("transaction_id", "_u.status", "_u.transfer_state")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def lookup(tx: DataFrame, ident: str) -> DataFrame:
    """By transaction id, or by number where all are digits."""
    return tx.where(F.col("seq") == int(ident)) if ident.isdecimal() else tx.where(F.col("transaction_id") == ident)


def add_rates(rates: DataFrame, per_usd: dict[str, float]) -> DataFrame:
    """Rates (from_currency, to_currency, rate) to US dollars, those that are there left as they are."""
    new = rates.sparkSession.createDataFrame([(c, "USD", 1 / r) for c, r in per_usd.items()], "from_currency string, to_currency string, rate double")
    return rates.select(*new.columns).unionByName(new.join(rates, ["from_currency", "to_currency"], "left_anti").select(*new.columns))


def status_kind(status: Column) -> Column:
    """matched, partial or unmatched."""
    return F.when(status == "matched", "matched").when(status.isin("partial", "pending_settlement", "amount_mismatch"), "partial").otherwise("unmatched")


def status_label(status: Column) -> Column:
    """What a status is called; an unknown one by its own words."""
    return (
        F.when(status == "matched", "Matched").when(status.isin("partial", "amount_mismatch"), "Partial / Fee discrepancy").when(status == "pending_settlement", "Pending settlement")
        .when(status.isin("unmatched", "missing_in_erp"), "Unmatched").otherwise(F.translate(F.coalesce(status, F.lit("")), "_", " "))
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "mid").otherwise("low")


def forecast_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.round(F.sum(c), 2).alias(c) for c in ("inflow", "outflow", "predicted_amount")))
