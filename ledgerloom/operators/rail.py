"""Jobs over rail messages with headers and bodies: routing, flattening, association, callbacks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .messages import condition

#: Media types and the resources whose headers are rewritten.
PLAIN, ISO = "application/vnd.interoperability.", "application/vnd.interoperability.iso20022."
BOTH = ("/quotes", "/transfers", "/fxQuotes", "/fxTransfers", "/participants")
RESOURCES = {"get": ("/parties", *BOTH), "put": ("/parties", *BOTH), "post": BOTH, "patch": ("/transfers", "/fxTransfers")}
PARTY = "struct<Id: struct<OrgId: struct<Othr: struct<Id: string, SchmeNm: struct<Prtry: string>>>, PrvtId: struct<Othr: struct<Id: string, SchmeNm: struct<Prtry: string>>>>>"
AGENT = "struct<FinInstnId: struct<Othr: struct<Id: string>>>"
CREDIT = f"struct<CdtTrfTxInf: struct<PmtId: struct<TxId: string, EndToEndId: string>, IntrBkSttlmAmt: struct<Ccy: string, ActiveCurrencyAndAmount: string>, CdtrAgt: {AGENT}, DbtrAgt: {AGENT}, Cdtr: {PARTY}, Dbtr: {PARTY}>>"


def bind(rule: dict, environment: dict) -> dict:
    """A condition with ``{$environment.x}`` values replaced, before it is compiled."""
    if isinstance(rule, list):
        return [bind(x, environment) for x in rule]
    if isinstance(rule, dict):
        return {k: bind(v, environment) for k, v in rule.items()}
    if isinstance(rule, str) and (m := re.fullmatch(r"\{\$environment\.(\w+)\}", rule)):
        return environment[m[1]]
    return rule


def first_rule(messages: DataFrame, rules: list[dict], value) -> Column:
    """``value(rule)`` of the first rule that holds for a message, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(condition(r["conditions"], messages.schema), F.lit(value(r))).otherwise(out)
    return out


def forward_to(messages: DataFrame, rules: list[dict]) -> Column:
    """The provider that the first matching rule of type FORWARD names. Facts may be maps, such as headers, with a path."""
    return first_rule(messages, [r for r in rules if r["event"]["type"] == "FORWARD"], lambda r: r["event"]["params"]["dfspId"])


def bound_by_table(rule, parameters: Column):
    """A condition with ``{$environment.x}`` values as look-ups in a column of parameters, a map from names to texts."""
    if isinstance(rule, list):
        return [bound_by_table(x, parameters) for x in rule]
    if isinstance(rule, dict):
        return {k: bound_by_table(v, parameters) for k, v in rule.items()}
    if isinstance(rule, str) and (m := re.fullmatch(r"\{\$environment\.(\w+)\}", rule)):
        return F.try_element_at(parameters, F.lit(m[1]))
    return rule


def classify_bound(messages: DataFrame, rules: list[dict], parameters: DataFrame, environment: str) -> DataFrame:
    """``event`` of the first rule that holds, with values of the message's own environment: parameters (environment, name, value). A
    parameter that an environment lacks is absent, as a null fact is. Of several values of a name the greatest counts. The planner
    broadcasts the table of parameters if it is small, and else shuffles both sides."""
    own = parameters.groupBy(environment, "name").agg(F.max("value").alias("value"))
    own = own.groupBy(environment).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_parameters"))
    rows = messages.join(own, environment, "left")
    return rows.withColumn("event", first_rule(rows, [r | {"conditions": bound_by_table(r["conditions"], F.col("_parameters"))} for r in rules], lambda r: r["event"]["type"])).drop("_parameters")


def endpoint(method: Column, path: Column, fsp: Column, default: str, endpoints: list[dict] = (), by_fsp: dict | None = None) -> Column:
    """Where a callback goes: by provider (the first endpoint of the method, else its default), or by resource (the first
    whose template is found in the path), else ``default``."""
    out = F.lit(default)
    for e in reversed(list(endpoints)):
        out = F.when((method == e["method"]) & path.rlike(re.sub(r"\{.*\}", ".*", e["path"])), e["endpoint"]).otherwise(out)
    for name, conf in (by_fsp or {}).items():
        own = F.lit(conf["default"])
        for e in reversed(conf["endpoints"]):
            own = F.when((method == e["method"]) & (path != ""), e["endpoint"]).otherwise(own)
        out = F.when(fsp == name, own).otherwise(out)
    return out


def iso_transfer(body: Column) -> Column:
    """Flat transfer fields of an ISO 20022 credit transfer; null fields for other bodies."""
    x = F.from_json(body, CREDIT)["CdtTrfTxInf"]

    def party(side: str) -> list[Column]:
        ids = x[side]["Id"]
        filled = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
        org, person = ids["OrgId"]["Othr"], ids["PrvtId"]["Othr"]
        return [filled(org["Id"], person["Id"]), filled(org["SchmeNm"]["Prtry"], person["SchmeNm"]["Prtry"])]

    (payee_type, payee), (payer_type, payer) = party("Cdtr"), party("Dbtr")
    fields = {
        "transaction_id": x["PmtId"]["EndToEndId"], "quote_id": x["PmtId"]["TxId"],
        "payee_id_type": payee_type, "payee_identifier": payee, "payee_fsp": x["CdtrAgt"]["FinInstnId"]["Othr"]["Id"],
        "payer_id_type": payer_type, "payer_identifier": payer, "payer_fsp": x["DbtrAgt"]["FinInstnId"]["Othr"]["Id"],
        "currency": x["IntrBkSttlmAmt"]["Ccy"], "amount": x["IntrBkSttlmAmt"]["ActiveCurrencyAndAmount"],
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def rewritten(headers: Column, method: Column, path: Column, back: bool = False) -> Column:
    """Headers with the media type of the other format in content-type and accept, names in any case, where the
    content type begins as expected and the resource is one that is transformed. The first occurrence changes."""
    have, want = (ISO, PLAIN) if back else (PLAIN, ISO)
    kind = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "content-type")
    routed = F.lit(False)
    for m, paths in RESOURCES.items():
        for p in paths:
            routed = routed | ((method == m) & path.startswith(p))
    change = F.coalesce(F.get(kind, F.lit(0))["value"].startswith(have), F.lit(False)) & routed
    swap = lambda v: F.regexp_replace(v, f"^(.*?){re.escape(have)}", f"$1{want}")
    new = F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin("content-type", "accept"), swap(v)).otherwise(v))
    return F.when(change, new).otherwise(headers)


def transfer_id(body: Column) -> Column:
    part = lambda p: F.nullif(F.get_json_object(body, p), F.lit(""))
    return F.coalesce(part("$.transferId"), part("$.commitRequestId"), part("$.CdtTrfTxInf.PmtId.TxId"))


def transfer_kind(path: Column) -> Column:
    return F.when(path.rlike("/fxTransfers"), "fxTransfer").when(path.rlike("/transfers"), "transfer")


def trace_id(traceparent: Column) -> Column:
    return F.get(F.split(traceparent, "-"), F.lit(1))


def one_shot(messages: DataFrame, key: str, push: Column, pop: Column, minutes: int = 10) -> DataFrame:
    """(seq, key, pushed_seq) of every pop: the last push of its key within the time, if no other pop took it.

    A row without key is a key of its own: it finds nothing. A push replaces the stored one and a pop empties the store, so the event of the key right before a pop decides:
    one sorted pass with a lag, whose memory doesn't grow with the key.
    """
    events = messages.where(push | pop).withColumn("_push", push)
    lost = events.where(F.col(key).isNull() & ~F.col("_push")).select("seq", key, F.lit(None).cast(events.schema["seq"].dataType).alias("pushed_seq"))
    events = events.where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy("ts", "seq")
    events = events.withColumn("_last", F.lag(F.struct("_push", "ts", "seq")).over(w))
    fresh = F.col("_last._push") & (F.col("ts") <= F.col("_last.ts") + F.expr(f"interval {minutes} minutes"))
    return events.where(~F.col("_push")).select("seq", key, F.when(fresh, F.col("_last.seq")).alias("pushed_seq")).unionByName(lost)


def associate_quotes(messages: DataFrame, minutes: int = 10) -> DataFrame:
    """Transfers with the quote they belong to, or error 3208."""
    post = F.col("method") == "post"
    got = one_shot(messages, "transaction_id", post & (F.col("path") == "/quotes"), post & (F.col("path") == "/transfers"), minutes)
    return got.select("seq", F.col("pushed_seq").alias("quote_seq"), F.when(F.col("pushed_seq").isNull(), "3208").alias("error"))


def stored_transfers(messages: DataFrame, minutes: int = 10) -> DataFrame:
    """GETs of a transfer with the latest POST of it that none has taken yet."""
    get = (F.col("method") == "get") & F.col("path").rlike("^/transfers/[^/]+$")
    got = one_shot(messages, "transaction_id", (F.col("method") == "post") & (F.col("path") == "/transfers"), get, minutes)
    return got.select("seq", F.col("pushed_seq").alias("transfer_seq"))


def await_callbacks(listeners: DataFrame, inbound: DataFrame, seconds: int = 15) -> DataFrame:
    """listeners (listener, method, path, ts) with the first inbound message of the same method and path from then on,
    within the time, else null: a union in time order, read backwards, instead of a join on ranges."""
    a = listeners.select("method", "path", "ts", "listener", F.lit(None).cast("long").alias("seq"))
    heard = inbound.join(listeners.select("method", "path").distinct(), ["method", "path"], "left_semi")
    b = heard.select("method", "path", "ts", F.lit(None).cast("long").alias("listener"), "seq")
    here = F.when(F.col("seq").isNotNull(), F.struct("ts", "seq"))
    w = Window.partitionBy("method", "path").orderBy(F.desc("ts"), F.col("listener").isNotNull(), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("_next", F.last(here, ignorenulls=True).over(w)).where("listener is not null")
    ok = F.col("_next.ts") <= F.col("ts") + F.expr(f"interval {seconds} seconds")
    return out.select("listener", F.when(ok, F.col("_next.seq")).alias("callback_seq"))
