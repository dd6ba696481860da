"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: link each node's larger neighbours to the least of it
    and all its neighbours. Small: link each node and its smaller neighbours to the least of these."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low"))
    least = materialize(least.select("u", F.least("u", "low").alias("low")))
    out = both.join(least, "u")
    out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")) if large else out.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return materialize(out.where("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id with an edge. edges (u, v), any order. A round's steps
    are removed once the next one is written."""
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, old = state, set(written())
        e = star(star(e, True), False)
        release([x for x in written() if x not in old][:-1])
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
