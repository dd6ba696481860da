"""Language identification with language-bitmask n-gram filters.

Training counts the 4-grams of letters (a word's ends count as a sign) per language, over all
training documents. A gram belongs to a language if it makes up at least ``min_share`` of
the language's grams, and at least ``ratio`` of its largest share in any language; so a
language has at most 1 / min_share grams, however large the input. The filter is a Bloom filter sliced by bits:
each place holds a bitmask of languages, and the AND of a gram's places is the mask of all languages
that contain it. A text's grams give a count per language, corrected by that language's rate of false
positives; the highest share decides, ties by the language's number of training grams, then by name.

Cases. A null text, or one without letters, is ``und`` with score 0. A text with letters but no known gram gets
the language with the most training grams and score 0. With nothing to learn from, all are ``und``. Rows with null
language don't train. Repeated rows count each; they get equal results. An empty table gives no rows.
Very long texts are read to their end. Other columns go through ``predict`` unchanged; those named like its own, ``_lang_pred`` and
``_lang_score``, give way to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_of, materialize
from .hashing import mix, slices

GRAM, HASHES = 4, 3
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams back to back, their number per text, letters per text)."""
    data = np.frombuffer("\n\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    word = letters()[data]
    code = np.where(word, data, 0)
    keep = word.copy()
    keep[1:] |= word[:-1]  # one sign of other than letters after each word
    at = np.flatnonzero(keep)
    code = code[at].astype(np.uint64)
    edge = np.searchsorted(at, ends)
    n_letters = np.diff(np.concatenate(([0], np.cumsum(word)[ends - 1])))
    if len(code) < GRAM - 1:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), n_letters
    code = np.concatenate((np.zeros(1, np.uint64), code))
    edge = edge + 1
    n = len(code) - GRAM + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.uint64(0x100000001B3) + code[j : j + n]
        h = mix(h)
    # a gram belongs to the text in which its last sign is; grams begin one sign before the text
    first = np.concatenate(([1], edge[:-1]))
    lo, hi = np.clip(first - 1, 0, n), np.clip(edge - GRAM + 1, 0, n)
    count = np.maximum(hi - lo, 0)
    pick = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return h[pick], count, n_letters


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, count) of documents (lang, text)."""

    def go(batches):
        for b in batches:
            langs, texts = b.column(0), b.column(1)
            for lo, hi in slices(texts, 4_000_000):
                by: dict[str, list[str]] = {}
                for lang, t in zip(langs.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(t or "")
                for lang, some in by.items():
                    g, n = np.unique(grams(some)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "count"])

    return docs.mapInArrow(go, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


class LanguageFilter:
    def __init__(self, langs: list[str], rows: list[tuple[int, int]], per_gram: int = 16):
        """langs: most frequent in training first; rows: (gram, index of language)."""
        self.langs = langs
        size = 64
        while size < per_gram * len(rows):
            size *= 2
        self.mask = np.zeros((-(-max(1, len(langs)) // 64), size), np.uint64)
        gram = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        lang = np.array([r[1] for r in rows], np.int64)
        for at in self.places(gram):
            for i in range(len(langs)):
                self.mask[i // 64, at[lang == i]] |= np.uint64(1) << np.uint64(i % 64)
        self.false = np.array([float((self.mask[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) ** HASHES for i in range(len(langs))])

    def places(self, gram: np.ndarray):
        low, high = gram & np.uint64(0xFFFFFFFF), gram >> np.uint64(32) | np.uint64(1)
        for j in range(HASHES):
            yield ((low + np.uint64(j) * high) & np.uint64(self.mask.shape[1] - 1)).astype(np.int64)

    def counts(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Per text and language, how many grams the filter has."""
        out = np.zeros((len(count), len(self.langs)), np.int64)
        ends = np.cumsum(count)
        for w in range(self.mask.shape[0]):
            got = None
            for at in self.places(gram):
                got = self.mask[w, at] if got is None else got & self.mask[w, at]
            for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                total = np.concatenate(([0], np.cumsum((got >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)))
                out[:, i] = total[ends] - total[ends - count]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        gram, count, n_letters = grams(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        share = self.counts(gram, count) / np.maximum(count, 1)[:, None]
        share = np.clip((share - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(axis=1)
        known = n_letters > 0
        return [self.langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)], np.where(known, share.max(axis=1), 0.0)


def train(docs: DataFrame, min_share: float = 1e-5, ratio: float = 0.25) -> LanguageFilter:
    """Learn from (lang, text); at most languages / min_share rows reach the driver."""
    counts = materialize(count_grams(docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))))
    total = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    langs = [r["lang"] for r in total.orderBy(F.desc("total"), "lang").toLocalIterator()]
    share = counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("count") / F.col("total")).alias("share"))
    share = share.where(F.col("share") >= min_share)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    rows = share.join(top, "gram").where(F.col("share") >= ratio * F.col("top")).select("gram", "lang")
    code = {x: i for i, x in enumerate(langs)}
    rows = rows.toPandas()
    return LanguageFilter(langs, list(zip(rows["gram"].tolist(), rows["lang"].map(code).tolist(), strict=True)))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """Add ``_lang_pred`` and ``_lang_score``."""
    docs = free_of(docs, "_lang_pred", "_lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def go(batches):
        for b in batches:
            for lo, hi in slices(b.column(at), 2_000_000):
                part = b.slice(lo, hi - lo)
                lang, score = held.value.decide([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "_lang_pred", "_lang_score"])

    own = [T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())]
    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, *own]))


def is_held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
