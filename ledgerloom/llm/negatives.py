"""Hard negatives: rows of another label whose score is within a window below a positive's.

Vectors become integers floor(scale * x); a score is an integer inner product with an anchor. An anchor's positives are its ``k`` best
other rows of its label. For each positive, its negatives are the ``take`` best rows of other labels with a score from ``low`` to
``high`` hundredths of the positive's.

Anchor spanning trees. Anchors are put in order by label and by the signs of their products with fixed directions, and each 1024 that follow each
other in a label get a minimum spanning tree by distance. A candidate c has a product with a child anchor that differs from
that with the parent by the distance of the two times the length of c at most. So scores are computed for the tree's root,
and each child has bounds from its parent's; only candidates whose bounds meet one of the anchor's
windows (which end at the worst of its best so far) are scored anew, which narrows their bounds to a point for the children below.
A parent's bounds are dropped as soon as its last child, the one of the largest subtree, is done: few are held at once.

Grid. Blocks of anchors meet blocks of candidates, each pair in a task of its own, whose memory is that of two blocks: a
vector is sent as often as the other side has blocks. Candidates come in rounds, of 1, then 7, 56 ... blocks, and the best so
far end the windows of the next: what is kept of a round is at most 8 times the result.

Cases. A row with a null label or id, a null or empty vector or a null or non-finite component takes no part. Vectors of different
sizes are padded with zeros. Rows with the anchor's own id are no candidates of it; of rows with one id the least (label, vector) is
the anchor, and each stands as a candidate. Ties go to the smaller id. A positive that isn't above 0 has the negatives of the empty window
or of score 0. Pairs whose products could pass 2**53 are scored in integers of any size; a score beyond 64 bits is held at
the greatest or least number of 64 bits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, with_rank
from .topk import LONGEST, MOST, integers, matrix

#: Rows of a block at most, anchors of a tree, candidates that are bounded at once, and directions of the order.
BLOCK, TREE, STRIP, SIGNS = 1 << 14, 1 << 10, 1 << 12, 16
NONE = -(1 << 63)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, distance): places of rows in an order in which parents come first and the largest subtree last, each one's
    parent (-1: root) and distance to it; by Prim's algorithm."""
    n = len(v)
    parent, far = np.full(n, -1), np.full(n, np.inf)
    inside, added, at = np.zeros(n, bool), [], 0
    for _ in range(n):
        inside[at] = True
        added.append(at)
        d = np.sqrt(np.square(v - v[at]).sum(axis=1))
        nearer = ~inside & (d < far)
        parent[nearer], far[nearer] = at, d[nearer]
        at = int(np.argmin(np.where(inside, np.inf, far)))
    size, children = np.ones(n, int), [[] for _ in range(n)]
    for i in reversed(added[1:]):
        size[parent[i]] += size[i]
        children[parent[i]].append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(children[i], key=lambda c: -size[c])  # the largest is popped last
    return np.array(order, int), parent, np.where(parent < 0, 0.0, far)


def code(v: Column) -> Column:
    """Signs of the products with fixed directions, as a number."""
    spin = lambda j, i: F.sin((i + 1).cast("double") * (j + 1) * 12.9898)
    bit = lambda j: (F.aggregate(F.transform(v, lambda x, i: x * spin(j, i)), F.lit(0.0), lambda s, x: s + x) > 0).cast("int") * (1 << (SIGNS - 1 - j))
    out = bit(0)
    for j in range(1, SIGNS):
        out = out + bit(j)
    return out


def clip(score: int) -> int:
    return max(NONE, min(MOST, score))


class Best:
    """The best ``k`` of one window of one anchor: scores from low to high; ids of smaller numbers first."""

    def __init__(self, k: int, low: int, high: int, floor: int | None):
        self.k, self.low, self.high, self.floor = k, low, high, floor  # floor: the k-th best score of earlier blocks
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A score below this can't count."""
        own = int(self.scores[self.k - 1]) if len(self.scores) >= self.k else NONE
        return max(self.low, own, NONE if self.floor is None else self.floor)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.least()) & (scores <= self.high)
        if ok.any():
            s, i = np.concatenate((self.scores, scores[ok])), np.concatenate((self.ids, ids[ok]))
            top = np.lexsort((i, ~s))[: self.k]
            self.scores, self.ids = s[top], i[top]


def scan_tree(order, parent, far, v, own, windows, c, length, cid) -> None:
    """Add to the windows (of each anchor a list of Best) the candidates (c, length, cid), but for those of the anchor's own id."""
    last = {int(parent[i]): int(i) for i in order if parent[i] >= 0}
    for lo in range(0, len(cid), STRIP):
        part, size, ids = c[lo : lo + STRIP], length[lo : lo + STRIP], cid[lo : lo + STRIP]
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in map(int, order):
            p = int(parent[i])
            if p < 0:
                down = up = part @ v[i]
                meets = np.ones(len(ids), bool)
            else:
                wide = far[i] * (1 + 1e-9) * size + 1e-6
                down, up = bounds[p][0] - wide, bounds[p][1] + wide
                meets = np.zeros(len(ids), bool)
                for w in windows[i]:
                    meets |= (up >= w.least()) & (down <= w.high)
                at = np.flatnonzero(meets)
                exact = part[at] @ v[i]
                down[at] = up[at] = exact
                if last[p] == i:
                    del bounds[p]
            if i in last:
                bounds[i] = (down, up)
            at = np.flatnonzero(meets & (ids != own[i]))
            scores = np.rint(down[at]).astype(np.int64)
            for w in windows[i]:
                w.add(scores, ids[at])


def scan_giants(v, own, windows, c, cid) -> None:
    """The same in integers of any size."""
    whole = [[int(x) for x in row] for row in c]
    for a, me, mine in zip(v, own, windows, strict=True):
        if mine and len(whole):
            a = [int(x) for x in a]
            scores = np.array([clip(sum(x * y for x, y in zip(a, row, strict=True))) for row in whole], np.int64)
            other = cid != me
            for w in mine:
                w.add(scores[other], cid[other])


def search(trees: DataFrame, cands: DataFrame, wanted: DataFrame, n_blocks: int, width: int, k: int, same: bool) -> DataFrame:
    """(id, turn, other, score): of each anchor's windows the ``k`` best candidates. trees (ab, tree, place, parent, far, id, label, v); cands (cb, id,
    label, v); wanted (id, turn, low, high): windows of anchors. same: candidates of the anchor's label, else of all others."""
    n_anchors = trees.agg(F.max("ab")).first()[0] + 1
    rank = Window.partitionBy("id", "turn").orderBy(F.desc("score"), "other")
    best = None

    def cell(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        one = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        v, ids, labels = matrix(one("v"), width), one("id").to_numpy(), one("label").to_numpy()
        tree = one("tree").to_numpy(zero_copy_only=False)
        length = np.sqrt(np.square(v).sum(axis=1))
        is_anchor, small = ~np.isnan(tree), length < LONGEST
        cand = np.flatnonzero(~is_anchor)
        out = {x: [] for x in ("id", "turn", "other", "score")}
        anchors = np.flatnonzero(is_anchor)
        place, parent, far = (one(x).to_numpy(zero_copy_only=False) for x in ("place", "parent", "far"))
        anchors = anchors[np.lexsort((place[anchors], tree[anchors]))]
        listed = one("windows").take(pa.array(anchors)).to_pylist()
        windows = [[Best(k, w["low"], w["high"], w["floor"]) for w in ws or []] for ws in listed]
        starts = np.flatnonzero(np.diff(tree[anchors], prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(anchors)][: len(starts)], strict=True):  # none, if no anchor here has windows
            mine, label = anchors[lo:hi], labels[anchors[lo]]
            fit = cand[(labels[cand] == label) == same]
            many, few = fit[small[fit]], fit[~small[fit]]
            if small[mine].all():
                scan_tree(np.arange(hi - lo), parent[mine].astype(int), far[mine], v[mine], ids[mine], windows[lo:hi], v[many], length[many], ids[many])
            else:
                few = fit
            scan_giants(v[mine], ids[mine], windows[lo:hi], v[few], ids[few])
        for a, ws, mine in zip(anchors, listed, windows, strict=True):
            for w, b in zip(ws or [], mine, strict=True):
                out["id"] += [ids[a]] * len(b.ids)
                out["turn"] += [w["turn"]] * len(b.ids)
                out["other"] += b.ids.tolist()
                out["score"] += b.scores.tolist()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "turn": pa.array(out["turn"], pa.int32()), "other": pa.array(out["other"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    done, step = 0, 1
    while done < n_blocks:
        until = min(n_blocks, done + step)
        floors = wanted.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            floors = wanted.join(best.groupBy("id", "turn").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")), ["id", "turn"], "left")
        asked = floors.groupBy("id").agg(F.collect_list(F.struct("turn", "low", "high", "floor")).alias("windows"))
        columns = ["ab", "cb", "id", "label", "v", "tree", "place", "parent", "far", "windows"]
        a = trees.join(asked, "id").withColumn("cb", F.explode(F.sequence(F.lit(done), F.lit(until - 1)))).select(*columns)
        null = {c: F.lit(None).cast(a.schema[c].dataType) for c in columns[5:]}
        c = cands.where((F.col("cb") >= done) & (F.col("cb") < until)).withColumns({"ab": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))), **null}).select(*columns)
        new = a.unionByName(c).groupBy("ab", "cb").applyInArrow(cell, "id long, turn int, other long, score long")
        best = new if best is None else best.unionByName(new)
        best = materialize(best.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n"))
        done, step = until, step * 7 if step == 1 else step * 8
    return best


def hard_negatives(vectors: DataFrame, is_anchor, k: int = 5, take: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """vectors (vec_id, label, embedding) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    is_anchor: from the id column to a condition."""
    spark = vectors.sparkSession
    rows = integers(vectors.where("label is not null").withColumn("vec_id", F.col("vec_id").cast("long")), scale, "vec_id", "embedding", "label")
    rows = materialize(rows.select("id", F.col("label").cast("long").alias("label"), "v", "norm2"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    if not n or not anchors.take(1):
        return spark.createDataFrame([], shape)
    placed = with_rank(anchors.withColumn("code", code(F.col("v"))), ["label", "code", "id"], within="label")
    placed = placed.withColumn("tree", F.floor(F.col("rank") / TREE)).drop("rank", "code")

    def tree(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], width)
        order, parent, far = spanning_tree(v)
        at = np.argsort(order)
        parent = np.where(parent < 0, -1, at[parent])
        return pa.table({"id": t["id"], "label": t["label"], "v": t["v"], "group": t["tree"], "place": pa.array(at, pa.int32()), "parent": pa.array(parent, pa.int32()), "far": pa.array(far)})

    trees = placed.groupBy("label", "tree").applyInArrow(tree, "id long, label long, v array<double>, group long, place int, parent int, far double")
    # whole trees in blocks: at most BLOCK anchors of each
    heads = materialize(trees)
    numbered = with_rank(heads.where("parent < 0").select("label", "group"), ["label", "group"])
    numbered = numbered.select("label", "group", F.col("rank").cast("double").alias("tree"), F.floor(F.col("rank") / (BLOCK // TREE)).cast("int").alias("ab"))
    trees = materialize(heads.join(numbered, ["label", "group"]).drop("group"))
    n_blocks = max(1, -(-n // BLOCK), min(2 * shuffle_parts(spark), n // 512))
    cands = materialize(rows.select("id", "label", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int").alias("cb")))
    every = trees.select("id", F.lit(0).alias("turn"), F.lit(NONE).alias("low"), F.lit(MOST).alias("high"))
    positives = search(trees, cands, every, n_blocks, width, k, True)
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")).cast("int")
    positives = materialize(positives.select("id", turn.alias("turn"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    wide = F.col("positive_score").cast("decimal(38,0)")
    # whole numbers s with low * p <= 100 * s <= high * p
    part = lambda share: (wide * share / F.lit(100).cast("decimal(38,0)")).cast("decimal(38,6)")
    window = positives.select("id", "turn", F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high"))
    found = search(trees, cands, window.where("low <= high"), n_blocks, width, take, False)
    out = found.withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["id", "turn"])
    at = F.row_number().over(Window.partitionBy("id", "turn").orderBy(F.desc("negative_score"), "negative_id")).cast("int")
    return out.select(F.col("id").alias("anchor_id"), "positive_id", at.alias("rank"), "negative_id", "positive_score", "negative_score")
