"""Match scores, tiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(ref: Column) -> Column:
    return F.regexp_replace(ref, r"^\s+|\s+$", "")


def amount_score(tx_usd: Column, ledger_usd: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - F.abs(tx_usd - ledger_usd) / (tx_usd + 1e-5) * 100)


def confidence(name: Column, amount: Column, bonus: Column) -> Column:
    return name * 0.4 + amount * 0.4 + bonus


def stored(raw: Column) -> Column:
    """Rounded and capped; null without a score."""
    return F.when(raw.isNotNull(), F.least(F.lit(100.0), F.round(raw, 2)))


def tier(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low")


def status(score: Column) -> Column:
    return F.when(score >= 90, "matched").when(score >= 70, "partial").otherwise("unmatched")
