"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(x: Column) -> Column:
    """A double in plain decimals, with one at least and up to ten: 15400000.0, 434.78, 0.0001. From 1e16 on as Spark shows it."""
    digits = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(F.abs(x) < 1e16, F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)).otherwise(x.cast("string"))
