"""Operators against brute force on small tables with nulls, empties, ties, repeats and odd columns."""

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, jaccard_join, langid, mixing, sharding, token_index, topk, unigram, urls, winnowing
from ledgerloom.llm.queries import URL_RULES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _1 int"
WORDS = "the of and tion ing er in re at on".split()


def corpus():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) + r.choice(["", ".", ","]) for _ in range(n))
    base = say(120)
    texts = [None, "", "   ", "a", "日本 ▁ x", base, base, base.replace(base.split()[60], "zzz", 1), base + " tail", say(3000), "x" * 5000, *(say(30) for _ in range(20))]
    return [(i if i != 20 else None, t, None if i % 7 == 3 else ["en", "de"][i % 2], None if i == 4 else f"s{i % 3}", None, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_store(spark, docs, none):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in token_index.round_trip(docs, tokenizer("word_bpe_49k.json")).collect()}
    for i, t, *_ in sorted(corpus(), key=lambda x: -1 if x[0] is None else x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_index.round_trip(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_perfect_hash():
    keys = token_index.key_hash(np.arange(5000), np.zeros(5000, np.int64))
    index = token_index.Index(b"".join(token_index.index_bytes(keys, np.arange(5000), np.arange(5000), np.ones(5000))))
    ok, got = index.find(keys)
    assert ok.all() and (got["offset"] == np.arange(5000)).all()
    assert sorted(index.mph.slot(keys)) == list(range(5000))
    assert index.find(token_index.key_hash(np.arange(9000, 9500), np.zeros(500, np.int64)))[0].sum() == 0


def test_words_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), token_index.WordEncoder(tokenizer("word_bpe_49k.json"), "<u2")
    texts = ["It's don't O'Neil!!", "A.\nB é. É! ß- x<|endoftext|>Y <|EndOfText|>", "é. ́x", "12.5% (a)b...", " x\x1cy\tz"]
    ids, n = enc.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_jaccard_components(spark, docs, none):
    got = {r["key"]: r["component"] for r in jaccard_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert len(got) == len(corpus()) and got[5] == got[6] == got[7] == got[8] == 5
    assert all(got[i] == i for i in (0, 1, 2, 3, 4, 9, 10))
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.keep_one(docs).count() == len(corpus()) - 3


def brute_components(texts, k, num, den):
    """(set size, least reachable position) of each text, over all pairs."""
    sets, up = [], list(range(len(texts)))
    for t in texts:
        w = [x for x in re.split("[ \\t-\\r]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def families(seed=3):
    """Clusters of near copies of many sizes, a large one, texts that share a passage, short and odd texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    edit = lambda ws, p: " ".join(r.choice(vocab) if r.random() < p else w for w in ws)
    texts, passage, big = [], say(60), say(100)
    for _ in range(12):
        base = say(r.choice([20, 60, 150, 400]))
        texts += [edit(base, r.choice([0, 0.002, 0.01, 0.03])) for _ in range(r.choice([2, 5, 30]))]
    texts += [" ".join(passage + say(r.choice([2, 5, 10]))) for _ in range(60)]
    texts += [" ".join(say(r.choice([2, 4, 8, 40, 100]))) for _ in range(150)]
    texts += [edit(big, 0.01) for _ in range(120)]
    return [*texts, "", "  ", None, "a b", "A\tB", texts[0].upper(), " ".join(say(30_000))]


@pytest.mark.parametrize(("k", "num", "limits"), [(4, 85, jaccard_join.Limits()), (5, 80, jaccard_join.Limits(slab=500, hot=3, salt=4, block=8)), (4, 85, jaccard_join.Limits(slab=2000, hot=2, salt=2, block=5))])
def test_jaccard_join_equals_all_pairs(spark, k, num, limits):
    texts = families()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, c string").repartition(7)
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in jaccard_join.jaccard_components(docs, k, num, 100, limits).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_packed_ids():
    for t in ([7], [1, 2, 2, 9], [0, 1 << 47], [5, 5 + (1 << 32)]):
        ids, more = np.array(t, np.uint64), np.arange(len(t), dtype=np.uint16)
        back = jaccard_join.unpacked(jaccard_join.packed(ids, more), "<u2")
        assert (back[0] == ids).all() and (back[1] == more).all()
    code = jaccard_join.frequency_code(np.arange(1, 10**6, 7))
    assert (np.diff(code.astype(int)) >= 0).all() and code.max() < 256


def test_find_links_is_exact():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 10**6, 300).astype(np.uint64))
    sets = [np.unique(np.where(r.random(len(base)) < p, r.integers(0, 10**6, len(base)).astype(np.uint64), base)) for p in np.linspace(0, 0.2, 40)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    group = list(range(40))
    for i in range(40):
        for j in range(i):
            if near(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    mine = list(range(40))
    everyone = np.ones(40, bool)
    for u, v in jaccard_join.find_links(np.arange(40), np.array([len(x) for x in sets]), sets, everyone, everyone, np.arange(40), 85, 100):
        mine = [mine[v] if g == mine[u] else g for g in mine]
    same = lambda g: {frozenset(i for i in range(40) if g[i] == x) for x in g}
    assert same(mine) == same(group)


def test_sharding(spark, docs, none):
    rows = sharding.shard_documents(docs, 4).toPandas()
    assert len(rows) == len(corpus()) and rows["size"].sum() == sum(len((t or "").encode()) + 8 for _, t, *_ in corpus())
    assert rows.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert rows.groupby("text_crc32").shard.nunique().max() == 1
    assert sharding.shard_documents(none, 4).count() == 0
    assert sharding.best_fit_decreasing([("a", 6), ("b", 5), ("c", 4), ("d", 3), ("e", 2)], 10) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}


def test_mixing_margins(spark, docs, none):
    rows = mixing.mix(docs, topic=F.lit("t")).toPandas()
    assert len(rows) == len(corpus()) and rows._mix_probability.between(0, 1.0000001).all()
    raked = (rows._mix_tokens * rows._mix_weight).groupby(rows._mix_lang).sum()
    goal = rows.groupby("_mix_lang")._mix_tokens.sum() ** 0.8
    assert np.allclose(raked / raked.sum(), goal / goal.sum(), atol=0.02)
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(none).count() == 0


def test_mixing_volume(spark):
    few = [(0, "x " * 20, "Y", "X", 0, 0), (1, "x " * 20, "en", "X", 0, 0), (2, "x " * 20, "Y", "s0", 0, 0)]
    many = spark.range(3, 6003).selectExpr("id as doc_id", "repeat('w ', 200) as text", "if(id % 5 = 0, 'de', 'en') as lang", "if(id % 3 = 0, 's0', 's1') as source", "0L as n_chars", "0 as _1")
    docs = spark.createDataFrame(few, SCHEMA).unionByName(many)
    rows = mixing.mix(docs).toPandas().set_index("doc_id")
    expected = rows._mix_tokens * rows._mix_probability
    assert np.isclose(expected.sum(), rows._mix_tokens.sum() / 2) and abs(rows._mix_kept.mean() - 0.5) < 0.05
    assert (rows._mix_probability[:3] == 1).all() and rows._mix_probability[3:].max() < 1
    got = mixing.fit(mixing.with_cells(docs), tolerance=1e-6)
    margins = got.margins.toPandas().set_index(["margin", "value"])
    assert got.error <= 1e-6 and np.allclose(margins.raked, margins.target, atol=1e-6)
    x = expected.groupby(rows._mix_source).sum() / expected.sum()
    assert np.isclose(margins.reached["source", "X"], x["X"]) and x["X"] < margins.target["source", "X"]
    only = spark.createDataFrame([("X", 1.0)], "value string, share double")
    assert {r["doc_id"] for r in mixing.sample(docs, targets={"source": only}, rounds=3).select("doc_id").collect()} == {0, 1}
    assert mixing.rake(mixing.fit(mixing.with_cells(docs)).cells.drop("raked"), {m: only.toDF(m, "share") for m in mixing.MARGINS}, rounds=1)[1] > 0.5


def test_winnowing_by_hand(spark, docs, none):
    rows = winnowing.edited_fingerprints(docs).toPandas()
    assert len(rows) == len(corpus())
    x = rows.set_index("doc_id")
    assert x.fingerprint[5] == x.fingerprint[6] and x.near_next[5] == 1.0 and x.near_next[9] < 0.1 and x.near_edited[9] > 0.4
    assert winnowing.edited_fingerprints(none).count() == 0
    h = [5, 3, 3, 9, 1, 7, 1, 8, 2, 6, 4, 4, *range(50, 80)]
    pick = spark.createDataFrame([(h,)], "h array<long>").select(winnowing.chosen(F.col("h"), 4)).first()[0]
    want = sorted({max(range(s, s + 4), key=lambda i: (-h[i], i)) for s in range(len(h) - 3)})
    assert pick == want


def test_topk(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(120, 8)).astype("float32")
    rows = [(i, v[i].tolist(), i) for i in range(120)] + [(200, None, 1), (250, [], 1), (300, [float("nan")] * 8, 1), (7, v[7].tolist(), 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), lambda i: i % 50 == 0).toPandas()
    e = np.floor(256 * v.astype("float64")).astype("int64")
    for q in (0, 50, 100):
        all_ = sorted([(-int(e[q] @ e[i]), i) for i in [*range(120), 7] if i != q])[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == all_
    assert set(got.query_id) == {0, 50, 100}


def test_langid(spark, docs, none):
    model = langid.train(docs)
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == len(corpus()) and [rows[i]["_lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert all(r["_lang_pred"] in ("en", "de") for i, r in rows.items() if i not in (0, 1, 2))
    assert langid.predict(docs, langid.train(none)).where("_lang_pred <> 'und'").count() == 0


def test_pieces_round_trip_and_best(spark, docs, none):
    rows = unigram.encode(docs, tokenizer("piece_bpe_32k.model"), decoded=True).collect()
    assert all(r["_sp_text"] == (r["text"] or "") for r in rows)
    p = unigram.Pieces(tokenizer("piece_bpe_32k.model"))
    p.lists = tuple(x.tolist() for x in (p.trie.base, p.trie.check, p.trie.value))
    words = [b"\xfehello", b"\xfe\xfe\xfetionble", "日😀x".encode(), b"thingenan,"]
    assert unigram.viterbi(p, words) == [unigram.viterbi_long(p, w) for w in words]
    assert unigram.encode(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "bot", "c"), (2, 0, "assistant", "x"), (None, 0, None, None), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (3, 2, "user", "s")]
    rows += [(9, i, ["user", "assistant"][i % 2], str(i)) for i in range(400)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().sort_values(["conv_id", "turn", "seq"])
    text = out.groupby("conv_id", dropna=False).rendered.sum()
    assert text[1] == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert text[2] == "<|user|>\nx<|end|>\n<|assistant|>\n<|end|>\n" or text[2].startswith("<|user|>\n<|end|>\n<|assistant|>\nx")
    assert text[3].endswith("s<|end|>\n<|assistant|>\n<|end|>\n")
    assert text[9].count("<|end|>") == 400 and set(out[out.conv_id == 9].action) == {"keep"}


def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "http://b.net/de/2"), (3, "https://x.example.com/de/3#t"), (4, "http://y.org/fr/"), (5, None), (6, "no scheme"), (7, "http://xnet/en"), (8, "http://c.example.com/en/9")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert [got[i]["_url_rule"] for i in range(1, 9)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    assert (got[1]["_url_host"], got[1]["_url_path"]) == ("a.example.net", "/en/1") and got[5]["_url_host"] == got[6]["_url_path"] == ""
    assert [got[i]["_url_verdict"] for i in (1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "allow"]
