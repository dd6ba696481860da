"""Toxicity by multiple-instance learning.

A document is a bag of sentences; its label says only whether any of them is toxic. A sentence's score is logistic in its
distinct words, a document's is the noisy-or of its sentences: 1 - product of (1 - score). The loss of the
documents' labels goes back through that product to the sentences, so the model learns which sentences are to blame,
and names them.

A word stands for itself and for its beginnings of 3 to 7 letters (where it is longer), hashed. Weights start at the part of a
feature's log odds, of toxic against other documents, that is above twice its standard error, and are held near it; Adam takes
``ROUNDS`` steps over all documents of the sample.

Sample. The model is fitted on at most ``MOST`` labelled documents (toxic ones, others), the first by a hash of the id, of up to
``LONGEST`` code points; other documents count by their share in all labels. Features of the sample are made in many tasks, the fit
runs in one, and its weights (2 ** 18 numbers) reach the driver and all tasks. Everything else covers all rows and whole texts.

Cases. A null, empty or wordless text scores 0. Rows without a known label (null, or not 0 or 1) and with null ids teach
nothing; an id with several labels is toxic if any says so; of several texts of one id the least teaches. Without a toxic
document, or without any other, every score is 0. A stretch of over ``WORDS`` words without an end of sentence is cut into sentences of
that many. Repeated rows get equal scores. An empty table gives no rows. Columns that are named like the
added ones give way to them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_of, materialize

BUCKETS, MOST, LONGEST, WORDS = 1 << 18, (2000, 4000), 50_000, 64
#: Beginnings of words, and the number of documents that a feature is in at least.
BEGIN, RARE = range(3, 8), 4
ROUNDS, RATE, HOLD, BIAS = 100, 0.05, 1e-3, -6.0
WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def is_held_out(key: str = "doc_id") -> Column:
    """Rows whose labels aren't learnt; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    names = [f"={word}", *(f"^{n}{word[:n]}" for n in BEGIN if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names]


def sentences(text: str):
    """(start, end, words) of each stretch with words, places in code points of the text."""
    for s in SENTENCE.finditer(text):
        words = WORD.findall(s[0].lower())
        if len(words) <= WORDS:
            if words:
                yield s.start(), s.end(), words
            continue
        found = list(WORD.finditer(s[0]))
        for i in range(0, len(found), WORDS):
            part = found[i : i + WORDS]
            yield s.start() + part[0].start(), s.start() + part[-1].end(), [w[0].lower() for w in part]


class Model:
    """Weights of the features, and scores with them."""

    def __init__(self, weights: np.ndarray, bias: float, fitted: bool):
        self.weights, self.bias, self.fitted, self.known = weights, bias, fitted, {}

    def __getstate__(self):
        return self.weights, self.bias, self.fitted

    def __setstate__(self, state):
        self.__init__(*state)

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = float(self.weights[features(word)].sum())
        return got

    def score(self, text: str | None, least: float = 0.5) -> tuple[float, list[dict]]:
        """The document's score, and its sentences of at least the given score: {start, end, score}; of a document of that
        score with none such, the highest."""
        if not self.fitted or not text:
            return 0.0, []
        clean, spans, top = 0.0, [], None
        for start, end, words in sentences(text):
            z = self.bias + sum(map(self.weight, set(words)))
            clean -= np.logaddexp(0, z)
            p = 1 / (1 + np.exp(-z))
            if top is None or p > top["score"]:
                top = {"start": start, "end": end, "score": float(p)}
            if p >= least:
                spans.append({"start": start, "end": end, "score": float(p)})
        total = float(min(1.0, max(0.0, -np.expm1(clean))))
        return total, spans or [top] * (total >= least)


def noisy_or(logits: np.ndarray, bag: np.ndarray, n_bags: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each bag, logarithm of its complement) from the sentences' logits and their bags."""
    clean = np.bincount(bag, -np.logaddexp(0, logits), minlength=n_bags)
    return -np.expm1(clean), clean


def gradient(logits: np.ndarray, bag: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted log loss of the bags' labels, by the sentences' logits."""
    p, clean = noisy_or(logits, bag, len(toxic))
    by_bag = weight * np.where(toxic, -np.exp(clean) / np.maximum(p, 1e-12), 1.0)
    return by_bag[bag] / (1 + np.exp(-logits))


def fit_bags(bags: list[list[list[int]]], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from each document's sentences' features, labels and weights."""
    count = [len(s) for b in bags for s in b]
    feature = np.fromiter((f for b in bags for s in b for f in s), np.int64, sum(count))
    sentence = np.repeat(np.arange(len(count)), count)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    pairs = np.unique(bag[sentence] * BUCKETS + feature)
    often = np.bincount(pairs % BUCKETS, minlength=BUCKETS) >= RARE
    pairs, here = pairs[often[pairs % BUCKETS]], often[feature]
    sentence, (used, column) = sentence[here], np.unique(feature[here], return_inverse=True)
    of, on = np.searchsorted(used, pairs % BUCKETS), toxic[pairs // BUCKETS]
    a, b = np.bincount(of[on], minlength=len(used)), np.bincount(of[~on], minlength=len(used))
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    start = np.maximum(0.0, odds - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    w, slope, square = np.append(start, BIAS), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, ROUNDS + 1):
        by_sentence = gradient(np.bincount(sentence, w[column], minlength=len(count)) + w[-1], bag, toxic, weight)
        g = np.append(np.bincount(column, by_sentence[sentence], minlength=len(used)), by_sentence.sum()) / weight.sum()
        g[:-1] += HOLD * (w[:-1] - start)
        slope, square = 0.9 * slope + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (slope / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-10)
    out = np.zeros(BUCKETS)
    out[used] = w[:-1]
    return out, float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    known = materialize(known)
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(np.zeros(BUCKETS), BIAS, False)
    first = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = materialize(first(True, MOST[0]).unionByName(first(False, MOST[1])))  # at most the sum of MOST rows
    # the weight of another document: its share in all labels against its share in the sample
    share = (total[False] / min(total[False], MOST[1])) / (total[True] / min(total[True], MOST[0]))
    taught = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def read(batches):
        for b in batches:
            bags = [[[f for w in set(words) for f in features(w)] for _, _, words in sentences(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["id", "toxic", "bag"])

    def fit(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        if rows:
            toxic = np.array([r[1] for r in rows], bool)
            w, bias = fit_bags([r[2] for r in rows], toxic, np.where(toxic, 1.0, share))
            yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([bias])], ["w", "bias"])

    bags = taught.mapInArrow(read, "id long, toxic boolean, bag array<array<int>>")
    got = bags.repartition(1).mapInArrow(fit, "w array<double>, bias double").collect()
    return Model(np.array(got[0]["w"]), got[0]["bias"], True) if got else Model(np.zeros(BUCKETS), BIAS, False)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``_tox_score`` and ``_tox_spans``, the sentences to blame."""
    docs = free_of(docs, "_tox_score", "_tox_spans")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def go(batches):
        for b in batches:
            got = [held.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], span)], [*b.schema.names, "_tox_score", "_tox_spans"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, T.StructField("_tox_score", T.DoubleType()), T.StructField("_tox_spans", spans)]))
