"""Currency conversion and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of each currency per US dollar, and signs for display.
PER_USD = {"INR": 83.5, "EUR": 0.92, "GBP": 0.78, "KES": 129.5, "TZS": 2680.0, "UGX": 3720.0}
SIGNS = {"USD": "$", "INR": "₹", "EUR": "€", "GBP": "£", "KES": "KSh"}


def to_usd(amount: Column, currency: Column) -> Column:
    """Dollars; an unknown currency leaves the amount as it is, null or empty stands for USD."""
    code = F.upper(currency)
    rate = F.create_map(*(F.lit(x) for kv in PER_USD.items() for x in kv))[code]
    return F.when(rate.isNotNull(), amount / rate).otherwise(amount)


def formatted(amount: Column, currency: Column) -> Column:
    """Sign, or code and a space, before thousands with two decimals; the code in any case."""
    sign = F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv))[F.upper(currency)]
    return F.concat(F.coalesce(sign, F.concat(currency, F.lit(" "))), F.format_number(amount, 2))
