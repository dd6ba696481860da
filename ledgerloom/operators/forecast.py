"""Daily flow, ridge trend and the forecast rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_stream(tx: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, amount) of a stream of transfers, a day as soon as the newest transfer is ``late`` behind its end. Later ones of that day
    are dropped. State: a sum for each open day."""
    rows = tx.select(F.col("created_at").cast("timestamp").alias("ts"), "amount").withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    return sums.select(F.to_date("w.start").alias("day"), "amount")


def daily_flow(tx: DataFrame, as_of: str, days: int = 30, baseline: DataFrame | None = None) -> DataFrame:
    """(idx, day, amount) of every day of the window before ``as_of``, 0 where nothing flowed. baseline (idx, amount) is
    added to the days' amounts."""
    if baseline is not None:
        flow = daily_flow(tx, as_of, days).join(baseline.groupBy("idx").agg(F.sum("amount").alias("_base")), "idx", "left")
        return flow.select("idx", "day", (F.col("amount") + F.coalesce("_base", F.lit(0.0))).alias("amount"))
    end = F.to_date(F.lit(as_of))
    sums = tx.where((F.col("created_at") >= F.date_sub(end, days).cast("timestamp")) & (F.col("created_at") < end.cast("timestamp"))).groupBy(F.to_date("created_at").alias("day")).agg(F.sum("amount").alias("amount"))
    calendar = tx.sparkSession.range(days).select(F.col("id").cast("int").alias("idx"), F.date_add(F.date_sub(end, days), F.col("id").cast("int")).alias("day"))
    return calendar.join(sums, "day", "left").select("idx", "day", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def ridge(flow: DataFrame, alpha: float = 1.0) -> DataFrame:
    """slope, intercept and the population deviation of residuals, the intercept without penalty."""
    fit = flow.agg((F.regr_sxy("amount", "idx") / (F.regr_sxx("amount", "idx") + alpha)).alias("slope"), F.avg("amount").alias("my"), F.avg("idx").alias("mx"), F.count("*").alias("n"))
    fit = fit.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    std = flow.join(F.broadcast(fit)).agg(F.stddev_pop(F.col("amount") - F.col("slope") * F.col("idx") - F.col("intercept")).alias("std"))
    return fit.join(F.broadcast(std)).select("slope", "intercept", F.when(F.col("n") <= 1, 1500.0).otherwise(F.col("std")).alias("std"), "n")


def forecast(flow: DataFrame, as_of: str, horizon: int = 7) -> DataFrame:
    if not 1 <= horizon <= 14:
        raise ValueError("horizon is 1 to 14 days")
    days = flow.sparkSession.range(horizon).select(F.col("id").cast("int").alias("k"), F.date_add(F.to_date(F.lit(as_of)), F.col("id").cast("int") + 1).alias("forecast_date"))
    raw = F.col("slope") * (F.col("n") + F.col("k")) + F.col("intercept")
    weekend = F.weekday("forecast_date") >= 5
    p = F.round(F.greatest(F.lit(1000.0), F.when(weekend, raw * 0.65).otherwise(raw)), 2)
    out = days.join(F.broadcast(ridge(flow))).withColumn("predicted_amount", p)
    p = F.col("predicted_amount")
    return out.select("forecast_date", "predicted_amount", F.round(F.greatest(F.lit(0.0), p - 1.96 * F.col("std")), 2).alias("lower_bound"), F.round(p + 1.96 * F.col("std"), 2).alias("upper_bound"), F.round(p * 1.25, 2).alias("inflow"), F.round(p * 0.25, 2).alias("outflow"))
