"""Streams of transfers and rail messages.

Batch functions can run again on the same batch after a failure: the transfer feed skips keys that are stored, and a
versioned table writes the version of its batch anew. A group of stateful operators is what one provider or id has in one
micro-batch, which the source's options bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.messages import spent
from ..operators.updates import update_states
from ..sources.versioned import all_parts, drop_parts, latest, newest_parts, part_of, publish, read_parts, rewrite_parts, versions, write_parts  # noqa: F401

#: Fields of a transfer message, and the columns they become.
FIELDS = {"transactionId": "transaction_id", "referenceId": "reference_id", "payer": "payer", "payee": "payee", "payerFsp": "payer_fsp", "payeeFsp": "payee_fsp", "amount": "amount", "currency": "currency", "transferState": "transfer_state"}
#: Parts of the transfer feed's table, by hash of the key: a batch reads those that its keys are in.
PARTS = 256
#: Rows that a stateful operator puts out at once.
SLICE = 50_000


#: Fields that a transfer message must have.
REQUIRED = ("transactionId", "payer", "payee", "payerFsp", "payeeFsp", "amount")


def checked_transfers(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(transfer rows, rejected messages with a reason) of JSON messages. Rejected are those that are no JSON object, lack a required field, or
    whose amount is no number. A missing reference is made from the transaction id, so that a replay gives the same."""
    shape = ", ".join(f"{f} string" for f in FIELDS) + ", _bad string"
    x = F.from_json(F.col(column).cast("string"), shape, {"columnNameOfCorruptRecord": "_bad"})
    rows = messages.withColumn("_x", x)
    missing = F.array_compact(F.array(*(F.when(F.col(f"_x.{f}").isNull(), F.lit(f)) for f in REQUIRED)))
    amount = F.col("_x.amount").try_cast("double")
    reason = F.when(F.col("_x").isNull() | F.col("_x._bad").isNotNull() | ~F.trim(F.col(column).cast("string")).startswith("{"), "no JSON object")
    reason = reason.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(amount.isNull(), "amount is no number")
    rows = rows.withColumn("_reason", reason)
    made = F.concat(F.lit("REF-"), F.upper(F.substring(F.sha2("transaction_id", 256), 1, 16)))
    good = rows.where("_reason is null").select(*(amount.alias(c) if f == "amount" else F.col(f"_x.{f}").alias(c) for f, c in FIELDS.items()))
    good = good.withColumns({"reference_id": F.coalesce("reference_id", made), "currency": F.coalesce("currency", F.lit("USD")), "transfer_state": F.coalesce("transfer_state", F.lit("COMMITTED")), "status": F.lit("SUCCESS")})
    return good, rows.where("_reason is not null").select(*messages.columns, F.col("_reason").alias("reason"))


def transfers(messages: DataFrame, column: str = "value") -> DataFrame:
    """Transfer rows of the valid messages."""
    return checked_transfers(messages, column)[0]


def checked_feed(path: str, dead: str, column: str = "value", parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for JSON messages with two sinks: new transfers are appended to the table, rejected messages
    go to a version of ``dead`` for their batch, with the reason."""
    append = append_new(path, parts=parts)

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = checked_transfers(batch, column)
        append(good, batch_id)
        bad.write.mode("overwrite").parquet(f"{dead}/v={batch_id + 1}")

    return write


def append_new(path: str, key: str = "transaction_id", after: Callable[[DataFrame], None] | None = None, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of each key that isn't stored yet one row is appended; a repeat changes nothing. The table is
    kept in folders by hash of the key (column ``_part``), of which a batch reads those that it has keys of.
    ``after`` gets the whole table once per batch, to reconcile again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.withColumn("_at", F.monotonically_increasing_id())
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where("_n = 1").drop("_n", "_at")
        first = first.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        spark.createDataFrame([], first.schema).write.mode("append").partitionBy("_part").parquet(path)
        stored = spark.read.schema(first.schema).parquet(path)
        touched = [r["_part"] for r in first.select("_part").distinct().collect()]  # at most ``parts`` numbers
        new = first.join(stored.where(F.col("_part").isin(touched)).select(key, "_part"), [key, "_part"], "left_anti")
        new.select(*first.columns).write.mode("append").partitionBy("_part").parquet(path)
        if after is not None:
            after(spark.read.schema(first.schema).parquet(path).drop("_part"))

    return write


def next_version(path: str, change: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the table's version of this batch is ``change(version before, batch)``. A batch that runs again
    reads the same version before and overwrites its own. Of old versions ``keep`` stay, for readers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(change(latest(batch.sparkSession, path, batch_id + 1), batch), path, batch_id + 1, keep)

    return write


def state_updates(path: str, start: DataFrame, unknown: str | None = None, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for messages (transaction_id, status, transfer_state, ts, seq): the last of a batch sets the state of a
    stored transfer. Only parts of the table that have ids of the batch are read and written (``versioned.read_parts`` of
    ``newest_parts`` is the table). Ids that aren't stored change nothing; a batch's go to ``unknown``, if given. ``start``: the transfers before the first batch."""
    if not versions(start.sparkSession, path):
        write_parts(start, path, "transaction_id", 0, parts)

    def change(before: DataFrame, batch: DataFrame) -> DataFrame:
        return update_states(before, batch)[0]

    rewrite = rewrite_parts(path, start.schema, "transaction_id", change, parts)

    def write(batch: DataFrame, batch_id: int) -> None:
        if unknown is not None:
            spark = batch.sparkSession
            touched = {r["p"] for r in batch.select(part_of("transaction_id", parts).alias("p")).distinct().collect()}
            there = [folder for p, (_, folder) in sorted(newest_parts(spark, path, batch_id + 1).items()) if p in touched]
            update_states(read_parts(spark, start.schema, there), batch)[1].write.mode("overwrite").parquet(f"{unknown}/v={batch_id + 1}")
        rewrite(batch, batch_id)

    return write


def retained(path: str, minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the history (ts, ...) of the last minutes before the newest message so far."""

    def change(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        newest = rows.agg(F.max("ts").alias("_newest"))
        return rows.join(F.broadcast(newest)).where(F.col("ts") >= F.col("_newest") - F.expr(f"interval {minutes} minutes")).drop("_newest")

    return next_version(path, change)


def keep_recent(path: str, minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a history that expires: a batch writes its own rows alone, in folders by minute of ``ts``, and removes
    folders that are older than ``minutes`` before the newest message so far. Nothing of what is kept is read or written
    again. A batch that runs again overwrites its own folders. ``recent`` reads the history; rows without a time don't enter."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("ts").alias("_newest"))
        rows = batch.join(F.broadcast(newest)).where(F.col("ts") >= F.col("_newest") - F.expr(f"interval {minutes} minutes")).drop("_newest")
        rows = rows.withColumn("_part", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60))
        rows.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v={batch_id + 1}")
        drop_parts(batch.sparkSession, path, minutes)

    return write


def recent(spark: SparkSession, path: str, schema, minutes: int = 10) -> DataFrame:
    """The rows that ``keep_recent`` keeps: those of the last minutes before the newest."""
    there = all_parts(spark, path)
    last = max((p for p, _ in there), default=0)
    newest = read_parts(spark, schema, [folder for p, folder in there if p == last]).agg(F.max("ts").alias("_newest"))
    rows = read_parts(spark, schema, [folder for p, folder in there if p >= last - minutes])
    return rows.join(F.broadcast(newest)).where(F.col("ts") >= F.col("_newest") - F.expr(f"interval {minutes} minutes")).drop("_newest")


def first_within(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """A stream's first row of each key, where repeats come within ``delay``: the state is the keys of that time, and no stored table is
    read, however large it has grown. Rows that are later than the watermark are dropped. For repeats at any time see ``append_new``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def start(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there now, in batches that the source's options bound."""
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposure_numbers(messages: DataFrame) -> DataFrame:
    """What ``exposure`` needs of a message, without text or decimals but for its key."""
    x, unit = spent(), F.lit(Decimal(10**9))
    # an exact amount as three whole numbers, of which sums fit 64 bits: units of 10**9, of 1 and of 10**-9
    limbs = {"a": F.floor(F.abs(x) / unit).cast("long"), "b": (F.abs(x) % unit).cast("long"), "c": ((F.abs(x) % F.lit(Decimal(1))) * unit).cast("long")}
    signed = {n: (F.when(x < 0, -v).otherwise(v)).cast("long" if n == "a" else "int").alias(n) for n, v in limbs.items()}
    return messages.where("method = 'post' and path in ('/quotes', '/transfers')").select("seq", "ts", (F.col("path") == "/quotes").alias("quote"), "payee_fsp", "amount", *signed.values())


def exposure(messages: DataFrame, start_at: float = 1000.0) -> DataFrame:
    """Quotes with the allowance left to their payee's provider, as of the messages that came before: one number
    of state per provider. Within a batch the messages of a provider count by (ts, seq)."""
    rail = exposure_numbers(messages)

    def count(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # numbers alone, some 40 bytes a row: a provider may have a fifth of a large batch
        parts = [[c[n].to_numpy() for n in ("ts", "seq", "quote", "amount", "a", "b", "c")] for c in chunks]
        ts, seq, quote, amount, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((seq, ts))
        used = int(state.get[0].scaleb(9)) if state.exists else 0
        a, b, c = (np.cumsum(x[order], dtype=np.int64) for x in sums)
        state.update((Decimal(used + int(a[-1]) * 10**18 + int(b[-1]) * 10**9 + int(c[-1])).scaleb(-9),))
        at = np.flatnonzero(quote[order])  # a quote itself uses nothing
        for i in range(0, len(at), SLICE):
            here = at[i : i + SLICE]
            total = ((used + x * 10**18 + y * 10**9 + z) / 10**9 for x, y, z in zip(a[here].tolist(), b[here].tolist(), c[here].tolist(), strict=True))
            allowed, mine = start_at - np.fromiter(total, float, len(here)), amount[order[here]]
            yield pd.DataFrame({"seq": seq[order[here]], "payee_fsp": key[0], "amount": mine, "allowed": allowed, "error": np.where(mine > allowed, "5100", None)})

    return rail.groupBy("payee_fsp").applyInPandasWithState(count, "seq long, payee_fsp string, amount double, allowed double, error string", "used decimal(28,9)", "append", "NoTimeout")


def associate(messages: DataFrame, minutes: int = 10) -> DataFrame:
    """Transfers with the quote of their id that none took before, within the time, or error 3208: the last quote
    of an id is its state, which a transfer takes and which goes when it is too old."""
    rail = messages.where("method = 'post' and path in ('/quotes', '/transfers')").select("seq", F.col("ts").cast("timestamp").alias("ts"), "path", "transaction_id")
    keep = pd.Timedelta(minutes=minutes)

    def pop(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = (state.get[0], pd.Timestamp(state.get[1], unit="us")) if state.exists else None
        out = []
        for r in pd.concat(list(chunks)).sort_values(["ts", "seq"]).itertuples():
            if r.path == "/quotes":
                held = (int(r.seq), r.ts)
            else:
                fresh = held is not None and r.ts <= held[1] + keep
                out.append((int(r.seq), held[0] if fresh else None, None if fresh else "3208"))
                held = None
        if held is None:
            state.remove() if state.exists else None
        else:
            state.update((held[0], held[1].value // 1000))
            state.setTimeoutTimestamp(max(held[1].value // 1_000_000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"seq": pd.Series([x[0] for x in out], dtype="int64"), "quote_seq": pd.Series([x[1] for x in out], dtype="Int64"), "error": pd.Series([x[2] for x in out], dtype="object")})

    late = rail.withWatermark("ts", f"{minutes} minutes").groupBy("transaction_id")
    return late.applyInPandasWithState(pop, "seq long, quote_seq long, error string", "seq long, us long", "append", "EventTimeTimeout")


def await_callbacks(listeners: DataFrame, inbound: DataFrame, seconds: int = 15, late: str = "1 minute", methods: tuple[str, ...] | None = None) -> DataFrame:
    """listeners (listener, method, path, ts) with the first inbound message (seq, method, path, ts) of the same method and path
    from then on, within the time, else null: a left outer join of two streams over an interval. A listener's row comes once the
    watermark (``late`` behind the newest of either stream) has passed its time; so do the rows that both sides keep. A null
    method or path has no callback. Rows later than the watermark are dropped. ``methods``: all that listeners wait for, if known; messages of others
    are then read and move the watermark, but aren't kept. A listener for another method gets null."""
    both = listeners.select("method", "path", F.col("ts").cast("timestamp").alias("ts"), F.col("listener").alias("id"), F.lit(0).alias("heard"))
    both = both.unionByName(inbound.select("method", "path", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").alias("id"), F.lit(1).alias("heard")))
    both = both.withWatermark("ts", late)

    def side(heard: int, **names: str) -> DataFrame:
        # the condition reads ts, so it stays above the watermark, which hence advances with the rows of both streams
        return both.where(F.when(F.col("ts").isNotNull(), F.col("heard")) == heard).select(*(F.col(c).alias(n) for c, n in names.items()))

    asked = side(0, method="method", path="path", ts="since", id="listener")
    heard = side(1, method="_method", path="_path", ts="at", id="seq").where("_method is not null and _path is not null")
    if methods is not None:
        heard = heard.where(F.col("_method").isin(*methods))
    fits = (F.col("method") == F.col("_method")) & (F.col("path") == F.col("_path")) & (F.col("at") >= F.col("since")) & (F.col("at") <= F.col("since") + F.expr(f"interval {seconds} seconds"))
    first = F.min_by("seq", F.struct("at", "seq")).alias("callback_seq")
    return asked.join(heard, fits, "left_outer").groupBy("listener", "since").agg(first).select("listener", "callback_seq")
