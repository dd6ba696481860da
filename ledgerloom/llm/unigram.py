"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a SentencePiece model file. Scores are log probabilities: a unigram model's own, or,
where the file holds merge ranks (a BPE model), those of Zipf's law at the piece's rank,
-ln(rank + 1) - ln(H). The encoding of a text is the piece sequence of the highest sum of scores; among
equals the one whose last piece starts first, back to the start. A character without piece costs
the least score less 10 and becomes byte pieces.

White space: spaces are the marker U+2581 and one is put before the text; decoding undoes both. A literal
U+2581 goes through byte pieces, so every text decodes to itself. Where no piece has a marker after another
sign, or a line end, texts are cut there; the best sequence is that of the parts, and each
distinct part is encoded once per worker.

Cases. Null and empty texts have no pieces and decode to empty text. Repeated rows get equal results. An empty
table gives no rows. A long text without a place to cut goes character by character in memory of a few numbers each. Of equal sums the
first found stays. ``encode`` passes other columns through; those named ``_sp_ids`` or ``_sp_text`` give way to its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_of
from .hashing import slices

MARK, LITERAL = 0xFE, 0xFF  # bytes that no UTF-8 text has: a space marker, and a literal U+2581
MARK_TEXT = "▁".encode()


class DoubleArray:
    """A trie over byte strings: child of s by byte c is t = base[s] + c + 1, if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        n = 1 << 12
        base, check, value = [0] * n, [-1] * n, [-1] * n
        check[0] = 0
        hole, tail, todo = 1, 1, [(0, sorted(keys.items()), 0)]
        while todo:
            s, items, depth = todo.pop()
            groups: dict[int, list] = {}
            for key, v in items:
                if len(key) == depth:
                    value[s] = v
                else:
                    groups.setdefault(key[depth], []).append((key, v))
            if not groups:
                continue
            codes = list(groups)
            if len(check) < max(hole, tail) + 1024:
                for x, empty in ((base, 0), (check, -1), (value, -1)):
                    x += [empty] * len(x)
            if len(codes) == 1:  # fills the holes that nodes with more children leave
                while check[hole] != -1 or hole <= codes[0]:
                    hole += 1
                b = hole - codes[0] - 1
            else:
                b = tail
                while any(check[b + c + 1] != -1 for c in codes):
                    b += 1
                    if len(check) < b + 1024:
                        for x, empty in ((base, 0), (check, -1), (value, -1)):
                            x += [empty] * len(x)
                tail = max(tail, b - 64)
            base[s] = b
            for c in codes:
                check[b + c + 1] = s
            todo += [(b + c + 1, groups[c], depth + 1) for c in codes]
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Pieces:
    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_path)
        ids = range(m.get_piece_size())
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        score = np.array([m.get_score(i) for i in ids], np.float64)
        if len(plain) > 1 and np.array_equal(score[plain], np.round(score[plain])):
            rank = -score + 1
            score = -np.log(np.maximum(rank, 1)) - np.log((1 / np.arange(1, len(plain) + 1)).sum())
        self.score, self.unknown = score, float(score[plain].min()) - 10
        self.byte = np.zeros(256, np.int64)
        self.text = [b""] * len(ids)
        for i in ids:
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[1:-1], 16)
                self.byte[b], self.text[i] = i, bytes([b])
        keys = {m.id_to_piece(i).encode().replace(MARK_TEXT, bytes([MARK])): i for i in plain}
        for k, i in keys.items():
            self.text[i] = k.replace(bytes([MARK]), b" ")
        self.longest = max(map(len, keys))
        self.cut_marks = not any(MARK in k.lstrip(bytes([MARK])) for k in keys)
        self.cut_lines = not any(b"\n" in k for k in keys)
        self.trie = DoubleArray(keys)

    def fallback(self, char: bytes) -> list[int]:
        char = MARK_TEXT if char[0] == LITERAL else b" " if char[0] == MARK else char
        return [int(self.byte[b]) for b in char]


def char_length(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character by its first byte; 0 for a byte inside a character."""
    return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < MARK], [1, 0, 2, 3, 4], 1)


def viterbi(p: Pieces, words: list[bytes]) -> list[list[int]]:
    """The best pieces of each word, all words side by side, byte by byte."""
    n, size = len(words), np.array([len(w) for w in words])
    longest = int(size.max())
    data = np.zeros((n, longest + 1), np.uint8)
    data[np.arange(longest + 1) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    clen = char_length(data)
    best = np.full((n, longest + 1), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
    base, check, value = p.trie.base, p.trie.check, p.trie.value
    for i in range(longest):
        here = np.flatnonzero((size > i) & (clen[:, i] > 0))
        if not len(here):
            continue
        to = np.minimum(i + clen[here, i], size[here])
        cost = best[here, i] + p.unknown
        better = cost > best[here, to]
        r, to = here[better], to[better]
        best[r, to], start[r, to], piece[r, to] = cost[better], i, -1
        rows, state = here, np.zeros(len(here), np.int32)
        for d in range(i, min(longest, i + p.longest)):
            nxt = base[state] + data[rows, d] + 1
            ok = (check[nxt] == state) & (size[rows] > d)
            rows, state = rows[ok], nxt[ok]
            if not len(rows):
                break
            found = value[state]
            end = found >= 0
            r, v = rows[end], found[end]
            score = best[r, i] + p.score[v]
            better = score > best[r, d + 1]
            r, v = r[better], v[better]
            best[r, d + 1], start[r, d + 1], piece[r, d + 1] = score[better], i, v
    starts, pieces, out = start.tolist(), piece.tolist(), []
    for k, w in enumerate(words):
        at, ids = len(w), []
        while at > 0:
            lo, v = starts[k][at], pieces[k][at]
            ids += p.fallback(w[lo:at])[::-1] if v < 0 else [v]
            at = lo
        out.append(ids[::-1])
    return out


def viterbi_long(p: Pieces, w: bytes) -> list[int]:
    """The same for one long word, in memory of a few numbers per byte."""
    base, check, value = p.lists
    score, n = p.score.tolist(), len(w)
    best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    clen = char_length(np.frombuffer(w, np.uint8)).tolist()
    for i in range(n):
        if not clen[i]:
            continue
        to, now = min(n, i + clen[i]), best[i]
        if now + p.unknown > best[to]:
            best[to], start[to], piece[to] = now + p.unknown, i, -1
        s = 0
        for d in range(i, min(n, i + p.longest)):
            t = base[s] + w[d] + 1
            if check[t] != s:
                break
            s = t
            if (v := value[s]) >= 0 and now + score[v] > best[d + 1]:
                best[d + 1], start[d + 1], piece[d + 1] = now + score[v], i, v
    at, ids = n, []
    while at > 0:
        ids += p.fallback(w[start[at] : at])[::-1] if piece[at] < 0 else [piece[at]]
        at = start[at]
    return ids[::-1]


class Encoder:
    LONG = 128

    def __init__(self, pieces: Pieces, keep: int = 300_000):
        self.p, self.keep, self.seen = pieces, keep, {}
        if not hasattr(pieces, "lists"):
            pieces.lists = tuple(x.tolist() for x in (pieces.trie.base, pieces.trie.check, pieces.trie.value))

    def parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(parts of all texts back to back, their number per text)."""
        raw = [t.encode("utf-8", "replace").replace(MARK_TEXT, bytes([LITERAL])).replace(b" ", bytes([MARK])) for t in texts]
        raw = [bytes([MARK]) + t if t else b"" for t in raw]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(t) for t in raw])
        ends = np.cumsum(size)
        cut = np.zeros(len(data) + 1, bool)
        cut[(ends - size)[size > 0]] = True
        mark, line = data == MARK, data == 10
        if self.p.cut_marks:
            cut[1:-1] |= mark[1:] & ~mark[:-1]
        if self.p.cut_lines:
            cut[:-1] |= line
            cut[1:-1] |= line[:-1]
        starts = np.flatnonzero(cut[:-1])
        offsets = np.concatenate((starts, [len(data)])).astype(np.int64)
        count = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]), count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts back to back, their number per text)."""
        parts, count = self.parts(texts)
        coded = pc.dictionary_encode(parts)
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.seen) > self.keep:
            self.seen = {}
        new = sorted((w for w in words if w not in self.seen), key=len)
        for w in (w for w in new if len(w) > self.LONG):
            self.seen[w] = np.array(viterbi_long(self.p, w), "<i4").tobytes()
        new = [w for w in new if len(w) <= self.LONG]
        for lo in range(0, len(new), 8_000):
            some = new[lo : lo + 8_000]
            for w, ids in zip(some, viterbi(self.p, some), strict=True):
                self.seen[w] = np.array(ids, "<i4").tobytes()
        got = [self.seen[w] for w in words]
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(n) - n
        n, first = n[codes], first[codes]
        ids = np.frombuffer(b"".join(got), "<i4")[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(count)
        return ids, total[ends] - total[ends - count]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        if not hasattr(self, "flat"):
            self.size = np.array([len(t) for t in self.p.text])
            self.first = np.cumsum(self.size) - self.size
            self.flat = np.frombuffer(b"".join(self.p.text), np.uint8)
        n = self.size[ids]
        data = self.flat[np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        total = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(count)
        return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(total[ends - count].tolist(), total[ends].tolist(), strict=True)]


def encode(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``_sp_ids`` (array of int) and, where ``decoded``, ``_sp_text`` decoded from them."""
    docs = free_of(docs, "_sp_ids", "_sp_text")
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    at = docs.columns.index(text)

    def go(batches):
        enc = Encoder(held.value)
        for b in batches:
            for lo, hi in slices(b.column(at), 3_000_000):
                part = b.slice(lo, hi - lo)
                ids, count = enc.encode([t or "" for t in part.column(at).to_pylist()])
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                more = [pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if decoded:
                    more.append(pa.array(enc.decode(ids, count), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "_sp_ids", "_sp_text"][: len(part.columns) + len(more)])

    own = [T.StructField("_sp_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("_sp_text", T.StringType())] * decoded
    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, *own]))
