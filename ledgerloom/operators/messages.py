"""Jobs over payment-rail messages: classification, exposure limits, normalisation, retention."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


#: What JavaScript's Number() reads as a number: decimal forms, and whole numbers of other bases.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"
BASED = r"^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def as_number(fact: Column) -> Column:
    """Number(fact): 0 for empty text, 1 and 0 for booleans; null, which stands for NaN, for other text and absent facts."""
    text = F.regexp_replace(fact.cast("string"), r"^\s+|\s+$", "")
    digits = F.transform(F.filter(F.split(F.upper(F.substring(text, 3, 1 << 30)), ""), lambda c: c != ""), lambda c: (F.call_function("instr", F.lit("0123456789ABCDEF"), c) - 1).cast("double"))
    base = F.when(F.lower(F.substring(text, 2, 1)) == "x", 16.0).when(F.lower(F.substring(text, 2, 1)) == "o", 8.0).otherwise(2.0)
    based = F.aggregate(digits, F.lit(0.0), lambda n, d: n * base + d)
    return F.when(text == "", 0.0).when(text.rlike(BASED), based).when(text.isin("true", "false"), (text == "true").cast("double")).when(text.rlike(NUMBER), text.try_cast("double"))


def fact_of(c: dict, schema: StructType | None) -> tuple[Column, Column]:
    """(value, kind: string, number, boolean or other) of a condition's fact, or of what its dotted ``path`` names in it: a key
    of a map, a field of a struct, or a place in a JSON text."""
    fact, path = F.col(c["fact"]), c.get("path", "").removeprefix("$").removeprefix(".")
    kind = lambda t: F.when(t == "string", "string").when(t.isin(*NUMERIC) | t.startswith("decimal"), "number").when(t == "boolean", "boolean").otherwise("other")
    if not path:
        return fact, kind(F.typeof(fact))
    if schema is not None and isinstance(schema[c["fact"]].dataType, MapType):
        fact = F.try_element_at(fact, F.lit(path))
        return fact, kind(F.typeof(fact))
    if schema is not None and isinstance(schema[c["fact"]].dataType, StructType):
        fact = F.col(f"{c['fact']}.{path}")
        return fact, kind(F.typeof(fact))
    part = F.try_variant_get(F.try_parse_json(fact), f"$.{path}", "variant")
    return F.get_json_object(fact, f"$.{path}"), kind(F.lower(F.schema_of_variant(part)))


def condition(c: dict, schema: StructType | None = None) -> Column:
    """A rule's condition {fact, operator, value, path} as a Column; all/any nest. A null is an absent fact: it differs from
    every value, is in no list and holds no text. Equality is strict: text never equals a number. A value may be a Column of text."""
    if "all" in c or "any" in c:
        parts = [condition(x, schema) for x in c.get("all", c.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if "all" in c else (out | p)
        return out
    value, op = c["value"], c["operator"]
    fact, kind = fact_of(c, schema)
    number = as_number(fact)

    def same(v) -> Column:
        if isinstance(v, Column):
            return (kind == "string") & (fact.cast("string") == v)
        if v is None:
            return fact.isNull()
        if isinstance(v, bool):
            return (kind == "boolean") & (fact.cast("string") == str(v).lower())
        if isinstance(v, (int, float)):
            return (kind == "number") & (number == F.lit(float(v)))
        return (kind == "string") & (fact.cast("string") == F.lit(v))

    def among() -> Column:
        out = F.lit(False)
        for v in value:
            out = out | F.coalesce(same(v), F.lit(False))
        return out

    if op in ("equal", "notEqual", "in", "notIn"):
        held = F.coalesce(among() if op in ("in", "notIn") else same(value), F.lit(False))
        return held if op in ("equal", "in") else ~held
    if op in ("contains", "doesNotContain"):  # of a list
        held = F.array_contains(fact, value)
        return F.coalesce(held if op == "contains" else ~held, F.lit(False))
    if op in ("includesString", "excludesString"):
        held = F.coalesce(fact.cast("string").contains(value), F.lit(False))
        return held if op == "includesString" else ~held
    goal = as_number(value if isinstance(value, Column) else F.lit(value))
    if op == "numericEqual":
        return F.coalesce(number == goal, F.lit(False))
    if op == "numericNotEqual":
        return F.coalesce(number != goal, F.lit(True))
    compare = {"LessThan": number < goal, "LessThanInclusive": number <= goal, "GreaterThan": number > goal, "GreaterThanInclusive": number >= goal}
    name = op.removeprefix("numeric").removeprefix("numberString")
    return F.coalesce(compare[name[0].upper() + name[1:]], F.lit(False))


def classify(messages: DataFrame, rules: list[dict]) -> DataFrame:
    """The event type, and its params as JSON, of the first rule that holds, in the given order, else null."""
    event, params = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        holds = condition(r["conditions"], messages.schema)
        event = F.when(holds, F.lit(r["event"]["type"])).otherwise(event)
        params = F.when(holds, F.lit(json.dumps(r["event"]["params"]) if "params" in r["event"] else None).cast("string")).otherwise(params)
    return messages.withColumns({"event": event, "event_params": params})


def spent() -> Column:
    """What a message adds to its payee's exposure: a transfer's amount as an exact decimal, 0 for others and without amount."""
    return F.when(F.col("path") == "/transfers", F.coalesce(F.col("amount").cast("decimal(28,9)"), F.lit(0))).otherwise(F.lit(0)).cast("decimal(28,9)")


def exposure(messages: DataFrame, start: float = 1000.0, bucket: str = "hour") -> DataFrame:
    """Quotes with the allowance that earlier transfers to the payee's provider have left, in exact decimals. A provider may have a third of
    all messages, so sums go by ``bucket`` of time first: the window over a provider's whole history has one row per bucket."""
    rail = messages.where("method = 'post' and path in ('/quotes', '/transfers')").select("seq", "ts", "path", "payee_fsp", "amount", F.date_trunc(bucket, "ts").alias("_at"))
    used = spent()
    before = lambda *keys: Window.partitionBy("payee_fsp", *keys[:-1]).orderBy(*keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rail.groupBy("payee_fsp", "_at").agg(F.sum(used).alias("_sum"))
    sums = sums.select("payee_fsp", "_at", F.coalesce(F.sum("_sum").over(before(["_at"])), F.lit(0)).alias("_before"))
    here = rail.withColumn("_here", F.coalesce(F.sum(used).over(before("_at", ["ts", "seq"])), F.lit(0)))
    out = here.where("path = '/quotes'").join(sums, (here.payee_fsp.eqNullSafe(sums.payee_fsp)) & here["_at"].eqNullSafe(sums["_at"])).drop(sums.payee_fsp)
    out = out.withColumn("allowed", F.lit(start) - (F.col("_before") + F.col("_here")).cast("double"))
    return out.select("seq", "payee_fsp", "amount", "allowed", F.when(F.col("amount") > F.col("allowed"), "5100").alias("error"))


def callbacks(messages: DataFrame) -> DataFrame:
    """The last PUT of each path without ``/error``, and whether it was an error."""
    puts = messages.where("method = 'put'").select(F.regexp_replace("path", "/error$", "").alias("base_path"), F.col("path").endswith("/error").alias("is_error"), "ts", "seq")
    return puts.groupBy("base_path").agg(F.max_by(F.struct("seq", "is_error"), F.struct("ts", "seq")).alias("x")).select("base_path", "x.seq", "x.is_error")


def retained(messages: DataFrame, minutes: int = 10) -> DataFrame:
    """Messages of the last minutes before the newest."""
    newest = messages.agg(F.max("ts").alias("newest"))
    return messages.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"interval {minutes} minutes")).drop("newest")
