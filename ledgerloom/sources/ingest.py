"""Ledger files as tables: column aliases with defaults, amounts, ids, rejects, first-wins keys, appends.

Generated ids are hashes of the row's place in the file scan, so a retried task makes the same ones. They have
sixteen hexadecimal digits, as shorter ones would collide in large files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIGITS = 16
#: Fixed values. target: (aliases, default). A default "PREFIX-*" is a generated id.
LEDGER = {
    "transaction_id": (["transaction_id", "Transaction ID"], "TX-*"), "reference_id": (["reference_id", "Reference ID"], "REF-*"),
    "payer": (["payer", "Payer Name"], "Unknown Payer"), "payee": (["payee", "Payee Name"], "Unknown Payee"),
    "payer_fsp": (["payer_fsp", "Payer FSP"], "BankA"), "payee_fsp": (["payee_fsp", "Payee FSP"], "BankB"),
    "amount": (["amount", "Amount"], "0.0"), "currency": (["currency", "Currency"], "USD"),
}
BANK_CSV = {
    "bank_statement_id": (["bank_statement_id"], "BS-*"), "account_number": (["account_number"], "ACC-10098"), "counterparty": (["counterparty"], "Unknown"),
    "amount": (["amount"], "0.0"), "currency": (["currency"], "USD"), "transaction_type": (["transaction_type"], "CREDIT"), "reference_number": (["reference_number", "ref_id"], None),
}
BANK_SHEET = {
    "bank_statement_id": (["bank_statement_id", "Statement ID"], "BS-*"), "account_number": (["account_number", "Account Number"], "ACC-10098"),
    "counterparty": (["counterparty", "Counterparty", "Payer"], "Unknown"), "amount": (["amount", "Amount"], "0.0"), "currency": (["currency", "Currency"], "USD"),
    "transaction_type": (["transaction_type", "Type"], "CREDIT"), "reference_number": (["reference_number", "Reference Number"], ""),
}
ERP_CSV = {
    "erp_id": (["erp_id"], "ERP-*"), "invoice_number": (["invoice_number"], None), "customer_vendor_name": (["customer_vendor_name"], "Vendor Inc"),
    "expected_amount": (["expected_amount", "amount"], "0.0"), "currency": (["currency"], "USD"), "ledger_account": (["ledger_account"], "1100-RECEIVABLES"),
}
ERP_SHEET = {
    "erp_id": (["erp_id", "ERP ID"], "ERP-*"), "invoice_number": (["invoice_number", "Invoice Number"], ""), "customer_vendor_name": (["customer_vendor_name", "Vendor/Customer"], "Vendor Inc"),
    "expected_amount": (["expected_amount", "Amount"], "0.0"), "currency": (["currency", "Currency"], "USD"), "ledger_account": (["ledger_account", "Ledger Account"], "1100-RECEIVABLES"),
}
PROFILES = {("ledger", "csv"): LEDGER, ("ledger", "sheet"): LEDGER, ("bank", "csv"): BANK_CSV, ("bank", "sheet"): BANK_SHEET, ("erp", "csv"): ERP_CSV, ("erp", "sheet"): ERP_SHEET}
#: Columns of CSV files whose empty cell stays empty: their default is for files without the column.
CELLS = {"bank": {"account_number", "counterparty", "amount", "currency", "transaction_type"}, "erp": {"invoice_number", "customer_vendor_name", "currency", "ledger_account"}, "ledger": set()}
KEYS = {"ledger": "transaction_id", "bank": "bank_statement_id", "erp": "erp_id"}
SOURCES = {"ledger": "ledger", "mojaloop": "ledger", "hub": "ledger", "bank": "bank", "settlement": "bank", "statement": "bank", "erp": "erp", "invoice": "erp"}


def route(source: str | None, filename: str | None) -> tuple[str, str]:
    """(source, profile) of an uploaded file."""
    name = (source or "ledger").lower()
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}: ledger, bank or erp")
    return SOURCES[name], "sheet" if (filename or "").lower().endswith((".xlsx", ".xls")) else "csv"


def first_filled(columns: list[Column], default: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), default)


def surrogate(prefix: str, place: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat(F.lit(prefix), place.cast("string")), 256), 1, DIGITS)))


def normalise(raw: DataFrame, source: str, profile: str = "csv", batch: str = "") -> DataFrame:
    """Columns of the table, with ``_pos``, the row's place; ``batch`` tells uploads apart in generated ids."""
    amount = "expected_amount" if source == "erp" else "amount"
    rows = raw.withColumn("_pos", F.col("_place") if "_place" in raw.columns else F.struct(F.monotonically_increasing_id().alias("row")))
    out = []
    for target, (aliases, default) in PROFILES[source, profile].items():
        there = [F.col(f"`{a}`").cast("string") for a in aliases if a in raw.columns]
        if default and default.endswith("*"):
            value = first_filled(there, surrogate(default[:-1], F.concat_ws(":", F.lit(batch), F.to_json("_pos"))))
        elif profile == "csv" and target in CELLS[source] and there:
            value = F.coalesce(there[0], F.lit(""))
        else:
            value = first_filled(there, F.lit(default).cast("string"))
        out.append(value.alias(target))
    fixed = [F.lit("SUCCESS").alias("status"), F.lit("COMMITTED").alias("transfer_state")] if source == "ledger" else []
    out = rows.select(*out, *fixed, "_pos")
    return out.withColumns({"_text": F.col(amount), amount: F.expr(f"try_cast({amount} as double)")})


def ingest(raw: DataFrame, source: str, profile: str = "csv", existing: DataFrame | None = None, strict: bool = False, batch: str = "", by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejects with a reason). Of rows with one key the first counts; keys of ``existing`` are skipped.
    ``strict``: an amount that is no number fails the whole upload when it is read. ``by_file``: it rejects its file and no other
    (rows have a place, as ``read_csv`` gives them)."""
    key, amount = KEYS[source], "expected_amount" if source == "erp" else "amount"
    rows = normalise(raw, source, profile, batch)
    if strict:
        rows = rows.withColumn(amount, F.coalesce(F.col(amount), F.raise_error(F.concat(F.lit("not an amount: "), "_text")).cast("double")))
    if by_file:
        rows = rows.withColumn("_file", F.coalesce("_pos.file", F.lit("")))
        spoilt = rows.where(F.col(amount).isNull()).select("_file").distinct().withColumn("_spoilt", F.lit(True))
        rows = rows.join(spoilt, "_file", "left").drop("_file")
        bad = rows.where("_spoilt").select(key, F.col("_text").alias("amount_text"), F.when(F.col(amount).isNull(), "bad_amount").otherwise("bad_file").alias("reason"))
        rows = rows.where("_spoilt is null").drop("_spoilt")
    turn = F.row_number().over(Window.partitionBy(key, F.col(amount).isNull()).orderBy("_pos"))
    reason = F.when(F.col(amount).isNull(), "bad_amount").when(F.col("_turn") > 1, "duplicate_in_file")
    marked = rows.withColumn("_turn", turn).withColumn("reason", reason)
    good = marked.where("reason is null").drop("_turn", "_pos", "_text", "reason")
    if existing is not None:
        good = good.join(existing.select(key), key, "left_anti")
    rejected = marked.where("reason is not null").select(key, F.col("_text").alias("amount_text"), "reason")
    return good, rejected.unionByName(bad) if by_file else rejected


def place(*split: Column) -> Column:
    """(file, start of the split, place in the split) as one column that sorts in file order. The number that Spark gives rows has
    the partition in its high bits, which depends on the packing of splits; its low bits count on within a split."""
    return F.struct(*split, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files with header, all columns as strings, and ``_place``: rows in order of file name and position."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return rows.select("*", place(*at).alias("_place"))


PARTY = "map<string, string>"
#: Required fields of quote and transaction requests; those of a party, an amount or a type are objects.
REQUESTS = {
    "quote": {"quoteId": "string", "transactionId": "string", "payee": PARTY, "payer": PARTY, "amount": PARTY, "transactionType": PARTY},
    "transaction": {"transactionRequestId": "string", "payee": PARTY, "payer": PARTY, "amount": PARTY, "transactionType": PARTY},
}


def checked_requests(bodies: DataFrame, kind: str = "quote", column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) quote or transaction requests from JSON: the fields, objects as maps, and for a quote the amount type,
    SEND if none is given; rejected ones keep their columns, with the missing fields named in ``reason``."""
    fields = REQUESTS[kind] | ({"amountType": "string"} if kind == "quote" else {})
    rows = bodies.withColumn("_q", F.from_json(column, ", ".join(f"{f} {t}" for f, t in fields.items())))
    missing = F.array_compact(F.array(*(F.when(F.col(f"_q.{f}").isNull(), F.lit(f)) for f in REQUESTS[kind])))
    rows = rows.withColumn("_missing", missing)
    own = [F.coalesce("_q.amountType", F.lit("SEND")).alias(f) if f == "amountType" else F.col(f"_q.{f}").alias(f) for f in fields]
    valid = rows.where(F.size("_missing") == 0).select(*bodies.columns, *own)
    return valid, rows.where(F.size("_missing") > 0).select(*bodies.columns, F.concat(F.lit("missing: "), F.array_join("_missing", ", ")).alias("reason"))
