"""Exact top-k inner products over vectors sorted by length.

Vectors become integers floor(scale * x). Candidates are ranked by falling length and cut into blocks of that order.
Each task compares one block of queries with one block of candidates: both are rotated onto the principal
axes of all vectors (eigenvectors of the summed outer products: the right singular vectors), so that
a partial sum over the first axes holds most of the product, and the Cauchy-Schwarz bound on the
rest, the product of the residual lengths, prunes what can't reach the query's k-th best so far. The partial sums grow in steps of
16, 64 and all axes, each over what the one before has left. The products of what remains are exact. The longest block goes first for all
queries; its k-th best scores prune later blocks: only the (query block, candidate block) pairs in which the product of
lengths can reach the least goal of the block's queries are dealt, and only with the queries that can. For that, queries are put in blocks by
the length that they need. Each task returns k rows a query at most; a window picks the best.

Where lengths are alike, all blocks meet. Blocks then are the cells of a grid: with t tasks each vector is sent about sqrt(t) times. ``block_sizes`` gives
sides of equal length for as many tasks as keep the cluster busy, up to blocks of 8 MB, which bound a task's memory; beyond that the number of tasks, and
with it how often a vector is sent, grows with the products left, as any exact method with such tasks must.

Cases. A vector that is null or empty, or has a null or non-finite component, or a null id, takes no part. Vectors of
different sizes are padded with zeros. Rows with the query's own id are no candidates of it; of rows with one id the
least vector is the query, and each stands as a candidate. Ties go to the smaller id. Vectors whose products could pass 2**53 are
as exact as others: they are compared apart, in integers of any size, each with all queries, and if the query is such a vector, with
all candidates. A score beyond 64 bits is held at the greatest or least number of 64 bits. Components of over 2**62 after scaling count as that. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, with_rank

#: The longest candidates, which go first; the least and greatest side of a block of the grid, and the bytes of its vectors.
HEAD, LEAST_SIDE, MOST_SIDE, SIDE_BYTES = 4096, 1024, 16384, 1 << 23
HEADS = (16, 64)
#: Two vectors of less than this length have a product, and partial sums, of less than 2**53.
LONGEST = 9.0e7
MOST = (1 << 63) - 1


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    at, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False).astype(np.float64)
    flat, at = flat[at[0] : at[-1]], at - at[0]
    out = np.zeros((len(rows), width))
    size = np.diff(at)
    r = np.repeat(np.arange(len(rows)), size)
    out[r, np.arange(len(flat)) - at[:-1][r]] = flat
    return out


def finite(e: Column) -> Column:
    return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))


def integers(vectors: DataFrame, scale: int, vec_id: str, embedding: str, *more: str) -> DataFrame:
    """(id, v, norm2) of those that take part, and the columns ``more``."""
    values = F.col(embedding).cast("array<double>")
    x = F.transform(values, lambda e: F.least(F.lit(2.0**62), F.greatest(F.lit(-(2.0**62)), F.when(F.abs(e) < 2.0**54, F.floor(F.when(F.abs(e) < 2.0**54, e * F.lit(scale)).otherwise(0.0)).cast("double")).otherwise(e * F.lit(scale)))))
    fine = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(values, finite)
    rows = vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), x.alias("v"), *more)
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes by falling weight. The tasks' sums of outer products are added in the cluster, a row of the matrix at a
    time; the driver gets one matrix of width * width."""

    def go(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = matrix(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    def add(batches):
        total = {}
        for b in batches:
            for row, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[row] = total.get(row, 0) + sums.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["row", "sums"])

    rows = vectors.select("v").mapInArrow(go, "row long, sums array<double>")
    total = np.zeros((width, width))
    for r in rows.repartition("row").mapInArrow(add, "row long, sums array<double>").toLocalIterator():
        total[r["row"]] = r["sums"]
    return np.linalg.eigh(total)[1][:, ::-1]


def best_of_blocks(pairs: DataFrame, k: int, width: int, turn: np.ndarray) -> DataFrame:
    """pairs (qb, cb, least, id, v): queries (with ``least`` not null: the score to reach) and candidates."""
    heads = [h for h in HEADS if h < width] or [width]

    def solve(queries, cands):
        (qid, q, least), (cid, c, _) = queries, cands
        order = np.lexsort((cid, -np.einsum("ij,ij->i", c, c)))
        cid, c = cid[order], c[order]
        qt, ct = q @ turn, c @ turn
        rest = [[np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, h:], x[:, h:]))) for x in (qt, ct)] for h in heads]
        ids, scores = [np.zeros(0, np.int64)] * len(qid), [np.zeros(0)] * len(qid)
        low = least.copy()
        for at in range(0, len(cid), 512):
            s = np.arange(at, min(at + 512, len(cid)))
            rows, partial, done = np.arange(len(qid)), 0.0, 0
            for h, (qrest, crest) in zip(heads, rest, strict=True):
                partial = partial + qt[rows, done:h] @ ct[s, done:h].T
                bound = partial + np.outer(qrest[rows], crest[s])
                live = bound * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(bound).max(initial=0) >= low[rows, None]
                keep_q, keep_c = live.any(axis=1), live.any(axis=0)
                rows, s, partial, done = rows[keep_q], s[keep_c], partial[keep_q][:, keep_c], h
                if not len(rows):
                    break
            if not len(rows):
                continue
            exact = q[rows] @ c[s].T
            for i, score in zip(rows, exact, strict=True):
                ok = (score >= low[i]) & (cid[s] != qid[i])
                if not ok.any():
                    continue
                a, b = np.concatenate((ids[i], cid[s][ok])), np.concatenate((scores[i], score[ok]))
                top = np.lexsort((a, -b))[:k]
                ids[i], scores[i] = a[top], b[top]
                if len(top) == k:
                    low[i] = max(low[i], b[top[-1]])
        n = [len(x) for x in ids]
        return pa.table({"query_id": pa.array(np.repeat(qid, n)), "vec_id": pa.array(np.concatenate(ids) if n else np.zeros(0, np.int64)), "score": pa.array((np.concatenate(scores) if n else np.zeros(0)).astype(np.int64))})

    def go(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        least = t["least"].to_numpy(zero_copy_only=False).astype(np.float64)
        v = matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], width)
        ids, query = t["id"].to_numpy(), ~np.isnan(least)
        return solve(*((ids[m], v[m], least[m]) for m in (query, ~query)))

    return pairs.groupBy("qb", "cb").applyInArrow(go, "query_id long, vec_id long, score long")


def product(a: str, b: str) -> Column:
    """Exact inner product of two arrays of whole doubles, in decimals of products' halves: high and low parts of 31 bits."""
    half = float(1 << 31)
    high = lambda x: F.floor(x / F.lit(half))
    low = lambda x: (x - high(x) * F.lit(half)).cast("long")
    wide = lambda x: x.cast("decimal(38,0)")

    def term(x: Column, y: Column) -> Column:
        xh, yh, xl, yl = high(x), high(y), low(x), low(y)
        return F.coalesce(wide(xh * yh) * wide(F.lit(1 << 62)) + (wide(xh * yl) + wide(xl * yh)) * wide(F.lit(1 << 31)) + wide(xl * yl), wide(F.lit(0)))

    total = F.aggregate(F.zip_with(a, b, lambda x, y: term(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)))), wide(F.lit(0)), lambda s, x: wide(s + x))
    return F.least(wide(F.lit(MOST)), F.greatest(wide(F.lit(-MOST - 1)), total)).cast("long")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query.
    is_query: from the id column to a condition."""
    every = materialize(integers(vectors, scale, vec_id, embedding).withColumn("short", -F.col("norm2")))
    chosen = every.where(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "norm2")).alias("x")).select("id", "x.v", "x.norm2")
    small = F.col("norm2") < LONGEST**2
    found = by_length(every.where(small), chosen.where(small), k)
    giants = every.where(~small).select("id", "v")
    if giants.take(1):
        q, c = chosen.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), small.alias("_fits")), every.select(F.col("id").alias("vec_id"), "v", small.alias("_fits_too"))
        apart = q.join(c, (F.col("query_id") != F.col("vec_id")) & ~(F.col("_fits") & F.col("_fits_too")))
        apart = apart.select("query_id", "vec_id", product("qv", "v").alias("score"))
        found = apart if found is None else found.unionByName(apart)
    if found is None:
        return every.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_sizes(queries: int, candidates: int, width: int, tasks: int) -> tuple[int, int]:
    """Sides (queries, candidates) of a grid of about ``tasks`` blocks, equal where neither is short of rows."""
    most = max(LEAST_SIDE, min(MOST_SIDE, SIDE_BYTES // (8 * width)))
    fit = lambda n, rows: max(LEAST_SIDE, min(most, n, rows))
    pairs = queries * candidates / max(1, tasks)
    even = int(pairs**0.5) + 1
    q, c = fit(even, queries), fit(even, candidates)
    return fit(int(pairs / c) + 1, queries), fit(int(pairs / q) + 1, candidates)


def meetings(needs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(qb, cb, longest): pairs of blocks in which the longest candidate is long enough for one of the queries, from needs (qb, least_reach) and
    lengths (cb, longest). Lengths fall with cb, so a block of queries meets those from 1 to a last one, found by one
    pass over both sorted together: a row a block, less than a thousandth of the vectors."""
    none = F.lit(None).cast("long")
    both = lengths.select(F.col("longest").alias("x"), F.lit(0).alias("side"), "cb", none.alias("qb"))
    both = both.unionByName(needs.select(F.col("least_reach").alias("x"), F.lit(1).alias("side"), none.alias("cb"), "qb"))
    last = both.withColumn("last", F.max("cb").over(Window.orderBy(F.desc("x"), "side"))).where("side = 1 and last is not null")
    return last.select("qb", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("cb")).join(lengths, "cb")


def by_length(every: DataFrame, chosen: DataFrame, k: int) -> DataFrame | None:
    """(query_id, vec_id, score): all that can be among the k best of the chosen queries; null without any."""
    rows = materialize(with_rank(every, ["short", "id", "v"]).select("id", "v", "norm2", "rank"))
    queries = materialize(with_rank(chosen, ["id"]).select("id", "v", "norm2", "rank"))
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    asked = queries.count()
    if width is None or not asked:
        return None
    turn = axes(rows, width)
    names = ["qb", "cb", "id", "v", "least"]
    none = F.lit(None).cast("double").alias("least")
    block = lambda at, size: F.floor(at / size).cast("long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((asked - 1) // LEAST_SIDE).cast("long"))).alias("qb")
    cb = F.lit(0).cast("long").alias("cb")
    head = rows.where(F.col("rank") < HEAD).select(blocks, cb, "id", "v", none)
    longest = queries.select(block(F.col("rank"), LEAST_SIDE).alias("qb"), cb, "id", "v", F.lit(-1e300).alias("least"))
    first = materialize(best_of_blocks(longest.unionByName(head), k, width, turn))
    if n <= HEAD:
        return first
    low = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("low"))
    goal = queries.drop("rank").join(low.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.coalesce("low", F.lit(-1e300)))
    # the length from which on a candidate can reach a query's goal
    reach = F.when(F.col("least") <= 0, 0.0).otherwise((F.col("least") - 1) / 1.000001 / F.greatest(F.sqrt("norm2"), F.lit(1e-9)))
    q_side, c_side = block_sizes(asked, n - HEAD, width, 4 * shuffle_parts(every.sparkSession))
    goal = materialize(with_rank(goal.withColumn("reach", reach), ["reach", "id"]).withColumn("qb", block(F.col("rank"), q_side)))
    others = rows.where(F.col("rank") >= HEAD).withColumn("cb", 1 + block(F.col("rank") - HEAD, c_side))
    lengths = others.groupBy("cb").agg(F.sqrt(F.max("norm2")).alias("longest"))
    meets = materialize(meetings(goal.groupBy("qb").agg(F.min("reach").alias("least_reach")), lengths))
    ask = goal.join(meets, "qb").where(F.col("longest") >= F.col("reach"))
    cands = others.join(meets.select("qb", "cb"), "cb").select("qb", "cb", "id", "v", none)
    later = best_of_blocks(ask.select(*names).unionByName(cands.select(*names)), k, width, turn)
    return first.unionByName(later)
