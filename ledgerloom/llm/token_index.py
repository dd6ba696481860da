"""Token ids as binary shards with a minimal-perfect-hash index.

Format. A folder holds ``ids-<shard>.bin``: raw little-endian ids of the shard's documents back to
back (2 bytes where the vocabulary allows, else 4), then a 16-byte footer (magic, bytes per id,
number of ids). ``index-<bucket>.bin`` maps the document keys of one hash bucket to shard, offset
and length through a minimal perfect hash (levels of bit arrays with rank counts), and stores a
fingerprint of each key, so that keys that were never written are refused. Looking up a key costs
a constant number of probes. ``shards`` is a Parquet table with one row per shard.

Cases. Null and empty texts hold the end id alone. A null document id sorts first. A repeated
document id keeps all its rows: the index has one entry per (id, occurrence in sorted order).
A very long text is encoded alone. An empty table gives an empty store. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Files, doc_key, scratch, shuffle_parts
from .hashing import mix, slices

MAGIC = b"LLID"
INDEX_MAGIC = b"LLIX"
MASK = (1 << 64) - 1


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space, word by word.

    No token of such a tokenizer spans a space, nor the place between a letter and other signs
    than an apostrophe, and capitals don't matter to it. So the ids of a text are those of its
    pieces between such places; each distinct piece of a batch is encoded once, and kept in two generations of
    ``keep`` pieces: what is met again moves to the young one, which takes the old one's place once it is full.
    Texts with the opening of a special token go to the tokenizer whole.
    """

    SPECIAL, LETTER_THEN_SIGNS = "<|", r"([a-zß-öø-ÿ])([.,!?;:#$%&*)(\-]+)"
    #: Pieces that normalising only lowers and that stay whole: these go to the merges at once, as bytes.
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    PROBES = ("the", "Zebra", "naïveté", "Ünder", "ß", "ÿÿ")

    def __init__(self, path: str, dtype, keep: int = 150_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype, self.keep, self.young, self.old = np.dtype(dtype), keep, {}, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level pieces
        other = iter(range(256, 512))
        sign = {b: chr(b) if b in shown else chr(next(other)) for b in range(256)}
        self.bytes_of = {i: "".join(sign[b] for b in chr(i).encode()) for i in range(0x80, 0x100)}
        self.direct = all(self.of_letters(w) == self.tok.encode(w, add_special_tokens=False).ids for w in self.PROBES)

    def of_letters(self, word: str) -> list[int]:
        word = word.lower()
        return [t.id for t in self.tok.model.tokenize(word if word.isascii() else word.translate(self.bytes_of))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, self.SPECIAL)
        ids, count = self.by_pieces(pc.if_else(whole, "", texts))
        if (at := np.flatnonzero(whole.to_numpy(zero_copy_only=False))).size:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in at:
                parts[i] = np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.dtype)
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, count

    def by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(texts, self.LETTER_THEN_SIGNS, r"\1 \2"), " ")
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        pieces = list(map(self.young.get, words))
        new = [i for i, x in enumerate(pieces) if x is None]
        ask = []
        for i in new:
            if (x := self.old.get(words[i])) is None:
                ask.append(i)
            else:
                pieces[i] = x
        rest = []
        for i in ask:
            if self.direct and self.LETTERS.fullmatch(words[i]):
                pieces[i] = np.array(self.of_letters(words[i]), self.dtype).tobytes()
            else:
                rest.append(i)
        for lo in range(0, len(rest), 4_000):
            part = rest[lo : lo + 4_000]
            for i, e in zip(part, self.tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                pieces[i] = np.array(e.ids, self.dtype).tobytes()
        if len(self.young) + len(new) > self.keep:
            self.young, self.old = {}, self.young
        self.young.update((words[i], pieces[i]) for i in new)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(pieces), self.dtype)
        start = np.cumsum(size) - size
        n, first = size[codes], start[codes]
        ids = flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, total[ends[1:]] - total[ends[:-1]]


#: One encoder per worker process: its pieces serve all tasks that the process runs.
_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def key_hash(doc: np.ndarray, occ: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.int64).view(np.uint64)) + occ.astype(np.uint64))


class MinimalPerfectHash:
    """Keys (distinct 64-bit hashes) to 0..n-1. Level by level, a key that is alone at its place sets
    that bit and is done; those that collide go to the next level. The number of set bits before
    a key's bit is its slot."""

    SPREAD = 2

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two document keys have the same hash")
        sizes, levels = [], []
        while len(keys):
            size = -(-len(keys) * cls.SPREAD // 64) * 64
            at = cls.place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gives -1 or any other key's slot."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + self.place(keys[open_], level, size)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[open_[hit]] = (self.rank[bit >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, shard, offset, n) -> list[bytes]:
    mph = MinimalPerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = mph.slot(keys)
    for name, value in (("print", fingerprints(keys)), ("shard", shard), ("offset", offset), ("n", n)):
        slots[name][at] = value
    head = json.dumps({"sizes": mph.sizes, "n": len(keys)}).encode()
    return [INDEX_MAGIC, struct.pack("<I", len(head)), head, mph.words.tobytes(), slots.tobytes()]


class Index:
    def __init__(self, data: bytes):
        if data[:4] != INDEX_MAGIC:
            raise ValueError("not an index file")
        at = 8 + struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8:at])
        words = sum(head["sizes"]) // 64
        self.mph = MinimalPerfectHash(head["sizes"], np.frombuffer(data, "<u8", words, at))
        self.slots = np.frombuffer(data, SLOT, head["n"], at + 8 * words)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slots): found is false for keys whose fingerprint isn't the stored one."""
        at = self.mph.slot(keys)
        got = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        return (at >= 0) & (got["print"] == fingerprints(keys)), got


def occurrences(keys: np.ndarray, last: tuple) -> tuple[np.ndarray, tuple]:
    """How often each key of a sorted run came before; last: the key and count so far."""
    if not len(keys):
        return np.zeros(0, np.int64), last
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.arange(len(keys))
    occ = at - np.maximum.accumulate(np.where(new, at, 0))
    if last and keys[0] == last[0]:
        occ[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(keys)] += last[1]
    return occ, (keys[-1], int(occ[-1]) + 1)


def write_token_store(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, vocab_size: int = 49_408) -> None:
    """Encode every text, write the shards in ascending document order, then the index."""
    spark = docs.sparkSession
    dtype = "<u2" if max(vocab_size - 1, end_id) < 1 << 16 else "<u4"
    n = shuffle_parts(spark)

    def shards(batches):
        enc, last, entries, shard, at = encoder(tokenizer_path, dtype), (), [], TaskContext.get().partitionId(), 0
        first = next(batches, None)
        if first is None:
            return

        def payload():
            nonlocal at, last
            batch = first
            while batch is not None:
                for lo, hi in slices(batch.column(1), 3_000_000):
                    part = batch.slice(lo, hi - lo)
                    ids, count = enc.encode(part.column(1))
                    ends = np.cumsum(count)
                    yield np.insert(ids, ends, end_id).tobytes()
                    size = count + 1
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    occ, last = occurrences(keys, last)
                    entries.append((keys, occ, at + np.cumsum(size) - size, size))
                    at += int(size.sum())
                batch = None  # before the next one comes
                pa.default_memory_pool().release_unused()
                batch = next(batches, None)
            yield MAGIC + struct.pack("<IQ", np.dtype(dtype).itemsize, at)

        Files(out).write(f"ids-{shard:06d}.bin", payload())
        cols = [np.concatenate(x) for x in zip(*entries, strict=True)] if entries else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_pydict({"key": cols[0], "occ": cols[1], "shard": np.full(len(cols[0]), shard, np.int64), "offset": cols[2], "n": cols[3]})

    rows = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    entries = rows.mapInArrow(shards, "key long, occ long, shard long, offset long, n long")
    entries.write.parquet(f"{out}/entries")
    entries = spark.read.parquet(f"{out}/entries")
    total = entries.groupBy("shard").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"))
    total.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{out}/shards")

    def index(batches):
        got = [pa.Table.from_batches([b]) for b in batches]
        if got and (t := pa.concat_tables(got)).num_rows:
            c = {k: t[k].to_numpy() for k in t.column_names}
            order = np.argsort(c["bucket"], kind="stable")
            c = {k: v[order] for k, v in c.items()}
            cuts = np.flatnonzero(np.diff(c["bucket"])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(order)], strict=True):
                s = slice(lo, hi)
                keys = key_hash(c["key"][s], c["occ"][s])
                Files(out).write(f"index-{c['bucket'][lo]:06d}.bin", index_bytes(keys, c["shard"][s], c["offset"][s], c["n"][s]))
        yield pa.RecordBatch.from_pydict({"done": np.zeros(1, np.int64)})

    placed = entries.withColumn("bucket", bucket(n)).repartitionById(n, F.col("bucket").cast("int"))
    placed.mapInArrow(index, "done long").write.parquet(f"{out}/indexed")
    spark.createDataFrame([(n,)], "buckets int").write.parquet(f"{out}/layout")


def bucket(n: int):
    return F.pmod(F.xxhash64("key", "occ"), F.lit(n))


def lookup(spark: SparkSession, out: str, keys: DataFrame) -> DataFrame:
    """keys (key, occ) to (key, occ, shard, offset, n); keys that aren't stored give no row."""
    n = spark.read.parquet(f"{out}/layout").first()["buckets"]

    def find(batches):
        files, index = Files(out), {}
        for b in batches:
            which = b.column(2).to_numpy()
            for k in np.unique(which):
                if k not in index:
                    try:
                        with files.open(f"index-{k:06d}.bin") as f:
                            index = {k: Index(f.read())}
                    except FileNotFoundError:
                        continue  # no key of this bucket was ever written
                mine = np.flatnonzero(which == k)
                key, occ = b.column(0).to_numpy()[mine], b.column(1).to_numpy()[mine]
                ok, got = index[k].find(key_hash(key, occ))
                yield pa.RecordBatch.from_pydict({"key": key[ok], "occ": occ[ok]} | {c: got[c][ok].astype(np.int64) for c in ("shard", "offset", "n")})

    placed = keys.select("key", "occ").withColumn("bucket", bucket(n)).repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return placed.mapInArrow(find, "key long, occ long, shard long, offset long, n long")


def read_ids(spark: SparkSession, out: str, at: DataFrame, digest: bool = False) -> DataFrame:
    """(key, occ, shard, offset, n) to the same with ``ids`` (array of int), or with the crc32 of
    the ids as little-endian unsigned 32-bit integers where ``digest``. Each shard file is read
    forward once by the task that holds its rows."""
    shards = spark.read.parquet(f"{out}/shards")
    n = shuffle_parts(spark)

    def read(batches):
        files, name, f = Files(out), None, None
        for b in batches:
            shard, offset, size = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("shard", "offset", "n"))
            got = []
            for s, o, k in zip(shard.tolist(), offset.tolist(), size.tolist(), strict=True):
                if s != name:
                    name, f = s, files.open(f"ids-{s:06d}.bin")
                    f.seek(f.size() - 16)
                    magic, width, _ = struct.unpack("<4sIQ", f.read(16))
                    if magic != MAGIC:
                        raise ValueError("not a shard of ids")
                    f.seek(0)
                if f.tell() != o * width:
                    f.seek(o * width)
                ids = np.frombuffer(f.read(k * width), f"<u{width}").astype("<u4")
                got.append(zlib.crc32(ids.tobytes()) if digest else ids)
            last = pa.array(got, pa.int64()) if digest else pa.array(got, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, last], [*b.schema.names, "ids_crc32" if digest else "ids"])

    placed = at.join(F.broadcast(shards.select("shard", "first_token")), "shard")
    placed = placed.select("key", "occ", "shard", "offset", "n", (F.col("first_token") + F.col("offset")).alias("start"))
    placed = placed.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "offset")
    kind = "ids_crc32 long" if digest else "ids array<int>"
    return placed.mapInArrow(read, f"key long, occ long, shard long, offset long, n long, start long, {kind}")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the store of these documents, look every document up again and digest its ids."""
    spark = docs.sparkSession
    out = scratch(spark)
    write_token_store(docs, tokenizer_path, out, end_id)
    keys = docs.groupBy(doc_key().alias("key")).count().select("key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("occ"))
    got = read_ids(spark, out, lookup(spark, out, keys), digest=True)
    key = F.when(F.col("key") != F.lit(-(2**63)), F.col("key")).alias("doc_id")
    return got.select(key, "start", F.col("n").alias("n_tokens"), "ids_crc32")
