"""Tables in finished versions: a version counts once its job has succeeded, so a run that is killed half-way leaves the one before.

A table in parts keeps rows in folders by a hash of their key. A version has only the parts that changed; a part's newest one is
the table's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import hadoop_path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table, ascending."""
    at, fs = hadoop_path(spark, path)
    found = fs.listStatus(at) if fs.exists(at) else []
    names = [x.getPath().getName() for x in found]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(hadoop_path(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(done)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table (below ``before``), or null."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={known[-1]}") if known else None


def drop_version(spark: SparkSession, path: str, version: int) -> None:
    at, fs = hadoop_path(spark, f"{path}/v={version}")
    fs.delete(at, True)


def publish(rows: DataFrame, path: str, version: int | None = None, keep: int = 2) -> None:
    """Write the next version (or the given one anew). Of old versions ``keep`` stay, for readers."""
    spark = rows.sparkSession
    known = versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v={version if version is not None else (known[-1] + 1 if known else 0)}")
    for old in versions(spark, path)[:-keep]:
        drop_version(spark, path, old)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def newest_parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """{part: (version, folder)} of the newest finished version of each part (below ``before``)."""
    out = {}
    for v in versions(spark, path):
        if before is None or v < before:
            at, fs = hadoop_path(spark, f"{path}/v={v}")
            for x in fs.listStatus(at):
                name = x.getPath().getName()
                if name.startswith("_part="):
                    out[int(name[6:])] = (v, f"{path}/v={v}/{name}")
    return out


def all_parts(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(part, folder) of all finished versions."""
    out = []
    for v in versions(spark, path):
        at, fs = hadoop_path(spark, f"{path}/v={v}")
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        out += [(int(n[6:]), f"{path}/v={v}/{n}") for n in names if n.startswith("_part=")]
    return out


def drop_parts(spark: SparkSession, path: str, span: int) -> None:
    """Remove parts of a number more than ``span`` below the greatest, and versions, but for the last, that have none left."""
    there = all_parts(spark, path)
    least = max((p for p, _ in there), default=0) - span
    for p, folder in there:
        if p < least:
            at, fs = hadoop_path(spark, folder)
            fs.delete(at, True)
    used = {folder.rsplit("/", 2)[1] for p, folder in there if p >= least}
    for v in versions(spark, path)[:-1]:
        if f"v={v}" not in used:
            drop_version(spark, path, v)


def read_parts(spark: SparkSession, schema, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_parts(rows: DataFrame, path: str, key: str, version: int = 0, parts: int = 256) -> None:
    """A version of the parts that ``rows`` are in, one file each."""
    rows.withColumn("_part", part_of(key, parts)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v={version}")


def drop_superseded(spark: SparkSession, path: str) -> None:
    """Remove parts that neither the newest version reads nor the one before, which a batch that runs again starts from."""
    known = versions(spark, path)
    used = {folder for before in (None, known[-1]) for _, folder in newest_parts(spark, path, before).values()}
    for v in known[:-1]:
        at, fs = hadoop_path(spark, f"{path}/v={v}")
        for x in fs.listStatus(at):
            name = x.getPath().getName()
            if name.startswith("_part=") and f"{path}/v={v}/{name}" not in used:
                fs.delete(x.getPath(), True)


def rewrite_parts(path: str, schema, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], parts: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over a table in parts: of the parts that a batch has keys of, ``change(rows, batch)`` is the
    next version; no other part is read or written. A batch that runs again reads what was there before and writes its version anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = {r["p"] for r in batch.select(part_of(key, parts).alias("p")).distinct().collect()}  # at most ``parts`` numbers
        there = newest_parts(spark, path, batch_id + 1)
        before = read_parts(spark, schema, [folder for p, (_, folder) in sorted(there.items()) if p in touched])
        write_parts(change(before, batch), path, key, batch_id + 1, parts)
        drop_superseded(spark, path)

    return write
