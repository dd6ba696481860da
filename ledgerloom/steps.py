"""Steps of a job that several later ones read: written to a folder which all machines share, and read again.

That cuts lineage, so nothing is computed twice, and survives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Makes Spark remove the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the tables that a step reads for each of its slices, and the most slices, as each reads the tables anew.
SLICE, SLICES = 16 << 20, 4
#: Folders written by ``materialize``, with the session that wrote them.
_written: dict[str, SparkSession] = {}
#: The folder of each table that ``materialize`` gave.
_folder: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop path, its file system); a path without scheme belongs to the cluster's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or else below the folder given to ``setCheckpointDir``. Where neither
    is set, a session on this machine alone gets a temporary folder; on a cluster that is an error, as its
    machines would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    path, fs = hadoop_path(spark, f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}")
    return fs.makeQualified(path).toString()


def materialize(*parts: DataFrame, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read again. ``release`` removes what was written. Shuffle files of the step go at its end. Parts of
    equal columns make one table: they are computed one after the other, so shuffle files of one at a time are on disk."""
    spark = parts[0].sparkSession
    path, before = shared_dir(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written[path] = spark
    out = spark.read.schema(parts[0].schema).parquet(path)
    _folder[out] = path
    return out


def slices_of(*steps: DataFrame) -> int:
    """In how many slices to take what reads these tables of ``materialize``: of large tables, shuffle files of a quarter are on disk at a time."""
    sizes = (fs.getContentSummary(at).getLength() for at, fs in (hadoop_path(x.sparkSession, _folder[x]) for x in steps))
    return min(SLICES, 1 + sum(sizes) // SLICE)


def slices(n: int, *by: str) -> list[Column]:
    """Conditions of which each row meets one; rows of equal ``by`` meet the same."""
    return [F.pmod(F.xxhash64(*by), F.lit(n)) == i for i in range(n)] if n > 1 else [F.lit(True)]


def forget(*steps: DataFrame) -> None:
    """Remove tables that ``materialize`` gave and no later step reads."""
    release([_folder[x] for x in steps])


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, which ``release`` removes."""
    path = shared_dir(spark)
    _written[path] = spark
    return path


def written() -> list[str]:
    return list(_written)


def release(steps: list[str] | None = None) -> None:
    """Remove the given steps, or all of this process: when the results that read them are written, or at the end."""
    for path in written() if steps is None else steps:
        spark = _written.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            at, fs = hadoop_path(spark, path)
            fs.delete(at, True)


atexit.register(release)
