"""Shared helpers: tables, materialised steps in the shared folder, global ranks, binary files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import materialize, release, scratch, shared_dir, written  # noqa: F401

#: Key that stands for a null document id: it sorts first and equals itself in joins.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by name, whatever signs the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def free_of(df: DataFrame, *own: str) -> DataFrame:
    """Without the columns that are named like those that an operator adds, in any case: these give way."""
    taken = {c.lower() for c in own}
    return df.select(*named([c for c in df.columns if c.lower() not in taken]))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind a value once inside one expression, so that lambdas below don't evaluate it again."""
    return F.transform(F.array(value), body)[0]


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def with_rank(df: DataFrame, order: list[str], rank: str = "rank", within: str | None = None) -> DataFrame:
    """Add the gapless global rank (from 0) in the given order, or the rank within ``within``,
    the leading order column. Rows are range-partitioned and sorted once; only one row per
    partition (and per value of ``within`` there) goes through a small window.
    """
    n = shuffle_parts(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    keys = [F.col(within)] if within else []
    names = [within] if within else []
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    on = placed.withColumn("_part", part).join(F.broadcast(runs), [*names, "_part"])
    return on.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


class Files:
    """Binary files in any store that pyarrow opens by its URI (file, hdfs, s3, gs)."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))

    def write(self, name: str, pieces) -> None:
        """Write under a name of this attempt, then rename: a retried task replaces the whole file."""
        path, part = f"{self.root}/{name}", f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(part) as out:
            for x in pieces:
                out.write(x)
        self.fs.move(part, path)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")
