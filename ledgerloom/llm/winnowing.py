"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is lower-cased and cut into tokens: runs of letters and digits of up to 24 signs, with every ideograph
or kana a token of its own. A token's hash is a polynomial of 59 bits over GF(2); each k tokens in a row have the hash
x1 z^(k-1) + ... + xk, which rolls: adding the next token is a shift and an exclusive or, and the token that leaves is one more.
It is mixed to 63 bits. Of every w in a row the one with the least leading 32 bits is chosen, the rightmost
among equals; chosen (hash, position of the first token) pairs, each once, are the fingerprint. So
two texts that share w + k - 1 tokens in a row share a chosen hash. A text of few hashes takes a
smaller window, down to 1, whose choice includes that of any larger window: the guarantee still holds.

The least of w is found by doubling: of 2 from single ones, of 4 from those of 2, and so on.

Likeness is the Jaccard similarity of the distinct hashes.

Cases. A null text is an empty one; texts without tokens have an empty fingerprint, and likeness 1 to each
other, 0 to others. Fewer tokens than k make one gram. Equal texts have equal fingerprints. A null
document id sorts first. Rows with one id share their next document, the next distinct id's least
text by its beginning; every row gets a row. Very long texts are fingerprinted whole, and short ones with smaller windows, as said. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_key, let, materialize, with_rank

#: Signs that are tokens alone (kana, ideographs), and the token pattern.
ALONE = r"\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"[a-z0-9[\p{{L}}\p{{N}}&&[^{ALONE}]]]{{1,24}}+|[{ALONE}]"
#: Positions take the low bits of a packed (rank, position), ranks the others.
PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1


def gram_hash(tokens: Column, first: Column, k: int) -> Column:
    """Rolling hash of k token hashes (64 - k bits each) from ``first`` (from 0) on, mixed; k given as a number."""
    h = F.get(tokens, first)
    for j in range(1, k):
        h = F.shiftleft(h, 1).bitwiseXOR(F.get(tokens, first + F.lit(j)))
    return F.shiftrightunsigned(F.xxhash64(h), 1)


def grams(tokens: Column, k: int) -> Column:
    n = F.size(tokens)
    short = F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", F.transform(tokens, lambda t: t.cast("string")))), 1)
    many = F.transform(F.sequence(F.lit(0), n - F.lit(k)), lambda i: gram_hash(tokens, i, k))
    return F.when(n == 0, F.array().cast("array<long>")).when(n < k, F.array(short)).otherwise(many)


def least_of(packed: Column, w: int) -> Column:
    """The least of each w in a row (of those there are, towards the end)."""
    step, out = 1, packed
    while step < w:
        out = let(out, least_of_two(min(step, w - step)))
        step += min(step, w - step)
    return out


def least_of_two(by: int):
    """Each element, or the one that comes ``by`` later if less."""
    return lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + F.lit(by))))


def chosen(ranks: Column, w: int) -> Column:
    """Positions of the winnowed among hashes of up to 32 bits, ascending."""
    # rank first, then the later position: the rightmost among equals is the least
    packed = F.transform(ranks, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(F.lit(LAST_PLACE).cast("long") - i))

    def pick(m: Column) -> Column:
        n = F.size(m)
        width = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
        few = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.array_min(F.slice(m, s, width)))
        return F.when(n == 0, F.array().cast("array<long>")).when(n < 4 * w, few).otherwise(F.slice(least_of(m, w), F.lit(1), n - F.lit(w - 1)))

    return F.transform(F.array_distinct(let(packed, pick)), lambda x: (F.lit(LAST_PLACE).cast("long") - x.bitwiseAND(F.lit(LAST_PLACE).cast("long"))).cast("int"))


def winnow(text: Column, k: int = 5, w: int = 8) -> Column:
    """array of (hash, at) of a text, in order of position."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    tokens = F.transform(words, lambda t: F.shiftrightunsigned(F.xxhash64(t), k))

    def pick(g: Column) -> Column:
        return F.transform(chosen(F.transform(g, lambda h: F.shiftrightunsigned(h, PLACE_BITS)), w), lambda i: F.struct(F.get(g, i).alias("hash"), i.alias("at")))

    return let(tokens, lambda t: let(grams(t, k), pick))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(fingerprint["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def as_text(fingerprint: Column) -> Column:
    """``hash@position`` of each chosen gram, the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["at"].cast("string"))), " ")


def next_documents(docs: DataFrame) -> DataFrame:
    """(key, prev) of distinct document keys, in a ring: prev's next document is key."""
    ids = materialize(with_rank(docs.select(doc_key().alias("key")).distinct(), ["key"]))
    n = ids.count()
    after = ids.select(F.col("key").alias("prev"), ((F.col("rank") + 1) % F.lit(max(n, 1))).alias("rank"))
    return materialize(ids.join(after, "rank").select("key", "prev"))


def edited_fingerprints(docs: DataFrame, k: int = 5, w: int = 8) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last quarter replaced by the
    beginning of the next document), and likeness to that and to the next document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key().alias("key"), text.alias("text"))
    ring = next_documents(docs)
    # what a document needs of the next: its beginning, at most as long as a quarter of the own text, and its hashes
    need = docs.groupBy(doc_key().alias("prev")).agg(F.max(F.floor(F.length(text) / 4)).alias("most"))
    ring = materialize(ring.join(need, "prev"))
    after = rows.join(ring, "key").select("prev", F.substring(F.col("text"), F.lit(1), F.col("most").cast("int")).alias("beginning"), hashes(winnow(F.col("text"), k, w)).alias("next_hashes"))
    after = after.groupBy(F.col("prev").alias("key")).agg(F.min(F.struct("beginning", "next_hashes")).alias("next"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.beginning"), F.lit(1), cut))
    out = rows.join(after, "key").select("key", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.next_hashes").alias("next_hashes"))
    out = out.withColumns({"own": winnow(F.col("text"), k, w), "other": winnow(F.col("edited"), k, w)})
    return out.select(
        F.when(F.col("key") != F.lit(NULL_KEY), F.col("key")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(hashes(F.col("own")), hashes(F.col("other"))).alias("near_edited"),
        likeness(hashes(F.col("own")), F.col("next_hashes")).alias("near_next"),
    )
