"""Operators against brute force and on awkward tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, jaccard_join, langid, mixing, sharding, token_index, topk, unigram, urls, winnowing
from ledgerloom.llm.queries import URL_RULES, tokenizer

CLASH = "doc_id long, text string, lang string, source string, n_chars long, key int, _sp_ids string, _SP_text int, _lang_pred int, _mix_tokens int, _mix_kept string, rank int, part int, slot int, h int"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null rows, ties and a very long text, under columns named like those of the operators."""
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["the", "und", "der", "of", "haus", "green"]) for _ in range(n))
    texts = [None, "", "x", say(50), say(50), say(40_000), "?!"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, None, None, None), (None, texts[4], "en", "a"), (12, texts[3], "de", "a")]
    return spark.createDataFrame([(*x, 5, 1, "own", 2, 3, 77, "kept", 4, 5, 6, 7) for x in rows], CLASH).repartition(3)


def test_every_operator_on_odd_rows(spark, odd):
    none = odd.limit(0)
    n = odd.count()
    path = tokenizer("word_bpe_49k.json")
    for df, size in ((odd, n), (none, 0)):
        assert token_index.round_trip(df, path).count() == size
        assert winnowing.edited_fingerprints(df).count() == size
        assert jaccard_join.jaccard_components(df).count() == size
        assert sharding.shard_documents(df, 3).count() == size
        got = unigram.encode(df, tokenizer("piece_bpe_32k.model"), decoded=True)
        assert len(set(map(str.lower, got.columns))) == len(got.columns) and got.where(F.col("_sp_text") != F.coalesce("text", F.lit(""))).count() == 0
        assert got.count() == size and got.where("size(_sp_ids) > 30000").count() == min(1, size)
        got = langid.predict(df, langid.train(df))
        assert got.count() == size and got.where("_lang_pred = 'und'").count() == (4 if size else 0) and got.where("_lang_pred = 'und' and _lang_score <> 0").count() == 0
        got = mixing.mix(df, rounds=3)
        assert got.count() == size and got.where("_mix_tokens = 77").count() == 0
        kept = mixing.sample(df, volume=1.0, rounds=3)
        assert kept.columns == df.columns and kept.where("_mix_tokens <> 77 or _mix_kept <> 'kept'").count() == 0
        assert urls.judge(df.withColumnRenamed("text", "url").withColumn("_url_host", F.lit(1)), URL_RULES).count() == size
        assert jaccard_join.keep_one(df).columns == df.columns
    same = {tuple(x) for x in jaccard_join.jaccard_components(odd).where("key in (3, 12)").select("component").collect()}
    assert same == {(3,)}


def tree_by_hand(paths, many, rare, delta):
    """{(host, tokens): template} of paths {(host, tokens): (n, purity)}, node by node."""
    out = {}

    def walk(host, mine, depth, template):
        if len(mine) == 1 or all(len(t) <= depth for t in mine):
            for t in mine:
                out[host, t] = (*template, *t[depth:])
            return
        for t in [t for t in mine if len(t) <= depth]:
            out[host, t] = template
        mine = {t: v for t, v in mine.items() if len(t) > depth}
        by = {}
        for t, v in mine.items():
            by.setdefault(t[depth], {})[t] = v
        size = {k: sum(n for n, _ in x.values()) for k, x in by.items()}
        total, step, groups = sum(size.values()), {}, []

        def kinds(k):
            c = {}
            for t, (n, _) in by[k].items():
                b = buckets[t[depth + 1] if len(t) > depth + 1 else ""]
                c[b] = c.get(b, 0) + n
            return c

        for k in sorted(by, key=lambda k: (-size[k], k)):
            if len(by) > many and size[k] < rare * total and k not in ("{n}", "{x}"):
                step[k] = "{*}"
                continue
            p, c = sum(n * q for n, q in by[k].values()) / size[k], kinds(k)
            bound = min(0.5, math.sqrt(math.log(2 / delta) / (2 * size[k])))
            for g in groups:
                far = sum(abs(g["c"].get(b, 0) / g["n"] - c.get(b, 0) / size[k]) for b in {*g["c"], *c}) / 2
                if abs(g["p"] - p) <= bound and far <= bound:
                    g["p"] = (g["p"] * g["n"] + p * size[k]) / (g["n"] + size[k])
                    g["n"] += size[k]
                    g["c"] = {b: g["c"].get(b, 0) + c.get(b, 0) for b in {*g["c"], *c}}
                    g["of"].append(k)
                    break
            else:
                groups.append({"of": [k], "n": size[k], "p": p, "c": c})
        for g in groups:
            step |= {k: g["of"][0] if len(g["of"]) == 1 else "{" + "|".join(sorted(g["of"])) + "}" for k in g["of"]}
        below = {}
        for k, x in by.items():
            below.setdefault(step[k], {}).update(x)
        for s, x in below.items():
            walk(host, x, depth + 1, (*template, s))

    buckets = tree_by_hand.buckets
    for host in {h for h, _ in paths}:
        walk(host, {t: v for (h, t), v in paths.items() if h == host}, 0, ())
    return out


def test_template_tree(spark):
    r = random.Random(4)
    rows = []
    for host in ("a.example.net", "b.example.com", "c.example.org"):
        for lang in ("en", "de", "es", "fr"):
            rows += [f"http://{host}/{lang}/{r.randrange(9999)}" + r.choice(["", ".html", "/"]) for _ in range(40)]
        rows += [f"http://{host}/shop/{r.choice('abcdefgh')}{i}/item/{i}" for i in range(60)]
        rows += [f"http://{host}/x/" + "/".join("deep" for _ in range(6 + i % 2)) for i in range(4)]
    rows += ["", None, "no scheme", "http://h", "http://h/", "http://h/?q"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(rows)], "page_id long, url string, host int")
    got = {x.page_id: x for x in urls.judge(pages, URL_RULES).collect()}
    tokens = {x.page_id: tuple(x.t) for x in pages.select("page_id", urls.tokens_of(urls.path_of(F.col("url"))).alias("t")).collect()}
    every = sorted({s for t in tokens.values() for s in t} | {""})
    tree_by_hand.buckets = {x.s: x.b for x in spark.createDataFrame([(s,) for s in every], "s string").select("s", F.pmod(F.xxhash64("s"), F.lit(urls.BUCKETS)).alias("b")).collect()}
    count, known = {}, {}
    for i, t in tokens.items():
        verdict = URL_RULES.get(got[i]["_url_rule"])
        x = count.setdefault((got[i]["_url_host"], t), [0, 0, 0])
        y = known.setdefault(t, [0, 0])
        x[0] += 1
        for k, v in enumerate(("block", "allow")):
            x[k + 1] += verdict == v
            y[k] += verdict == v
    of_path = {t: (b + 2 * 0.25) / (a + b + 2) for t, (b, a) in known.items()}
    paths = {(h, t): (n, (b + 2 * of_path[t]) / (a + b + 2)) for (h, t), (n, b, a) in count.items()}
    want = tree_by_hand(paths, 20, 0.05, 0.05)
    assert {i: x["_url_template"] for i, x in got.items()} == {i: "/" + "/".join(want[got[i]["_url_host"], t]) for i, t in tokens.items()}
    total = {}
    for (h, t), (n, b, a) in count.items():
        x = total.setdefault((h, want[h, t]), [0, 0, 0, 0.0])
        for k, v in enumerate((n, b, a, n * of_path[t])):
            x[k] += v
    for i, x in got.items():
        n, b, a, p = total[x["_url_host"], want[x["_url_host"], tokens[i]]]
        assert math.isclose(x["_url_purity"], (b + 2 * p / n) / (a + b + 2))
        assert x["_url_verdict"] == (URL_RULES.get(x["_url_rule"]) or ("block" if x["_url_purity"] >= 0.7 else "allow"))
    free = {(x["_url_host"], rows[i].split("/")[3]): x["_url_verdict"] for i, x in got.items() if x["_url_rule"] is None and rows[i] and rows[i].count("/") > 3}
    assert free["c.example.org", "de"] == "block" and free["b.example.com", "en"] == "allow"
    assert any("|" in x["_url_template"] for x in got.values()) and any("{*}" in x["_url_template"] for x in got.values())


def test_topk_takes_every_finite_vector(spark):
    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(60, 5)) * 4) / 4
    v[7], v[8], v[9] = 1e16, -1e16, [1e16, -1e16, 1, 0, 3]
    rows = [(i, [float(x) for x in v[i]], "n", 0.5) for i in range(60)] + [(50, [9.0] * 5, "n", 0.5), (101, [float("inf")] * 5, "n", 0.5), (102, [None] * 5, "n", 0.5), (None, [1.0] * 5, "n", 0.5), (103, [1.0, 1.0], "n", 0.5)]
    whole = lambda e: [math.floor(256 * x) for x in e] + [0] * (5 - len(e))
    have = [(i, whole(e)) for i, e, *_ in rows if i is not None and i not in (101, 102)]
    for k in (5, 100):
        got = {}
        for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, least string, score double"), lambda i: i % 10 == 0, k).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
        for q in range(0, 60, 10):
            mine = min(e for i, e in have if i == q)
            clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            want = sorted((-clip(sum(a * b for a, b in zip(mine, e, strict=True))), i) for i, e in have if i != q)[:k]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 10 == 0).count() == 0


@pytest.mark.parametrize("alike", [False, True])
def test_topk_by_a_grid_of_blocks(spark, monkeypatch, alike):
    """Small blocks, so that many meet: against all products, with lengths that differ and with lengths that are alike."""
    for name, value in (("HEAD", 8), ("LEAST_SIDE", 4), ("MOST_SIDE", 16)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 20))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * (1 if alike else r.exponential(size=(300, 1)))
    v[40:60] = v[20:40]
    e = np.floor(256 * v).astype("int64")
    got = topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), lambda i: i % 5 == 0).collect()
    want = {(q, n + 1, i, -s) for q in range(0, 300, 5) for n, (s, i) in enumerate(sorted((-int(e[q] @ e[i]), i) for i in range(300) if i != q)[:5])}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_topk_grid_sends_vectors_seldom():
    for queries, candidates, width, tasks in ((10_000, 50_000, 32, 32), (2_000_000, 100_000_000, 64, 4000), (3, 10**9, 4096, 10), (1, 1, 1, 1), (10**6, 10**6, 8, 10**4)):
        q, c = topk.block_sizes(queries, candidates, width, tasks)
        assert topk.LEAST_SIDE <= min(q, c) and max(q, c) <= max(topk.LEAST_SIDE, topk.SIDE_BYTES // (8 * width))
        old = queries * -(-candidates // 4096) + candidates * -(-queries // 1024)
        assert queries * -(-candidates // c) + candidates * -(-queries // q) <= 1.01 * old


def test_viterbi_is_best_of_all(spark):
    """Every way to cut short words into pieces, or characters of the unknown score, is tried."""
    p = unigram.Pieces(tokenizer("piece_bpe_32k.model"))
    score = {t: s for t, s in zip(p.text, p.score, strict=True) if len(t) > 0}
    r = random.Random(2)
    for _ in range(40):
        word = "".join(r.choice("theingatonß日x") for _ in range(r.randrange(1, 9)))
        cuts = []
        for mask in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate([*mask, 1]):
                if c:
                    parts.append(word[last : i + 1])
                    last = i + 1
            if all(x.encode() in score or len(x) == 1 for x in parts):
                cuts.append(sum(score[x.encode()] if x.encode() in score else p.unknown for x in parts))
        ids = unigram.viterbi(p, [word.encode()])[0]
        assert b"".join(p.text[i] for i in ids) == word.encode()
        total, at = 0.0, 0
        while at < len(ids):
            if ids[at] in p.byte:
                at += len(next(c for c in word if c.encode() == b"".join(p.text[i] for i in ids[at : at + len(c.encode())])).encode())
                total += p.unknown
            else:
                total, at = total + p.score[ids[at]], at + 1
        assert math.isclose(total, max(cuts), abs_tol=1e-6)


def test_language_filter(spark):
    """No gram that was built in is missed; held-out documents of the given table get their language."""
    g = np.arange(1, 3001, dtype=np.int64) * 7919
    f = langid.LanguageFilter(["a", "b"], [(int(x), i % 2) for i, x in enumerate(g)])
    n = f.counts(g.view(np.uint64), np.array([len(g)]))[0]
    assert n[0] >= 1500 and n[1] >= 1500 and n.sum() < 3300
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(d.where(langid.is_held_out()), langid.train(d.where(~langid.is_held_out())))
    known = out.where("lang is not null and _lang_pred <> 'und'")
    assert known.where("lang = _lang_pred").count() >= 0.98 * known.count() > 100


def test_role_repair_costs_least(spark):
    """All choices for all short conversations."""

    def least(roles):
        best = {0: 0.0}
        for role in roles:
            new = {}
            for s, c in best.items():
                for cost, to, *_ in chat.OPTIONS[role][s]:
                    new[to] = min(new.get(to, math.inf), c + cost)
            best = new
        return min(c + chat.end_cost(s) for s, c in best.items())

    for n in (1, 2, 3, 4):
        for roles in itertools.product((1, 2, 3, None), repeat=n):
            for cut in range(n):
                parts = [list(roles[:cut]), list(roles[cut:])] if cut else [list(roles)]
                runs = [(i, [x for s in range(4) for x in chat.costs(p, s)[0]]) for i, p in enumerate(parts)]
                names = {1: "system", 2: "user", 3: "assistant", None: "?"}
                at, rows = 0, []
                for part, begin, end, last in chat.fold(runs):
                    turns = [(at + i, names[r], "t") for i, r in enumerate(parts[part])]
                    at += len(turns)
                    rows += chat.repair(turns, begin, end, last)
                text = "".join(x[4] for x in rows)
                order = [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end")]
                assert all(a != b for a, b in zip(order, order[1:], strict=False)) and order[-1] == "assistant" and "system" not in order[1:] and order[0] in ("system", "user") and (order[0] == "user" or order[1] == "user")
                opened = sum(3 for x in rows if x[1] == 0) + sum(3 * x[4].count("<|end|>\n<|") for x in rows if x[1] == 2)
                acted = sum({"keep": 0, "relabel": 2}.get(x[3], 0) for x in rows if x[1] == 1)
                held, merged = None, 0
                for x in rows:
                    if x[1] == 1 and x[3] == "merge":
                        merged += 1 if names[roles[x[0]]] == x[2] else 3
                assert opened + acted + merged == least(roles)


def test_raking_by_hand(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(1, 300), r.choice(["en", "de", None]), r.choice(["a", "b", "\0", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = {"source": [("a", 0.5), ("b", 0.2), ("\0", 0.1), (None, 0.2)], "lang": [("en", 0.6), ("de", 0.3), (None, 0.1)], "topic": [("t", 1.0)]}
    got = mixing.fit(mixing.with_cells(docs, F.lit("t")), {m: spark.createDataFrame(x, "value string, share double") for m, x in goal.items()}, tolerance=1e-9)
    cells = {}
    for _, t, lang, source in rows:
        cells[source, lang] = cells.get((source, lang), 0) + t.count("w")
    total = sum(cells.values())
    x = {k: v / total for k, v in cells.items()}
    for _ in range(200):
        for m, at in (("source", 0), ("lang", 1)):
            for value, share in goal[m]:
                now = sum(v for k, v in x.items() if k[at] == value)
                x |= {k: v * share / now for k, v in x.items() if k[at] == value}
    mine = {(c.source, c.lang): c.raked for c in got.cells.select(mixing.plain(F.col("_mix_source")).alias("source"), mixing.plain(F.col("_mix_lang")).alias("lang"), "raked").collect()}
    assert got.error <= 1e-9 and set(mine) == set(x) and all(math.isclose(mine[k], x[k], abs_tol=1e-7) for k in x)
    assert {(m.margin, m.value): round(m.target, 9) for m in got.margins.collect()}["source", "\0"] == 0.1


def test_best_fit_decreasing_by_search():
    r = random.Random(9)
    for _ in range(50):
        items = [(i, r.randrange(1, 40)) for i in range(r.randrange(1, 30))]
        left, want = [], {}
        for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
            fits = [b for b, room in enumerate(left) if room >= size]
            b = min(fits, key=lambda b: (left[b], b)) if fits else len(left)
            if not fits:
                left.append(50)
            left[b] -= size
            want[key] = b
        got = sharding.best_fit_decreasing(items, 50)
        room = lambda out: sorted(sum(s for k, s in items if out[k] == b) for b in set(out.values()))
        assert room(got) == room(want)


def fit_one_by_one(sizes: list[int], capacity: int, shards: int | None) -> list[int]:
    """The bin of each item, placed singly by falling size (as given): the tightest that holds it, the highest of equal ones."""
    room, out = [capacity] * (shards or 0), []
    for size in sizes:
        fits = [b for b, x in enumerate(room) if x >= size]
        if fits:
            b = min(fits, key=lambda b: (room[b], -b))
        elif shards is None:
            b = len(room)
            room.append(max(capacity, size))
        else:
            b = max(range(shards), key=lambda b: (room[b], -b))
        room[b] -= size
        out.append(b)
    return out


@pytest.mark.parametrize("shards, capacity", [(5, None), (24, None), (None, 300), (None, 90)])
def test_groups_of_all_sizes_enter_one_by_one(spark, monkeypatch, shards, capacity):
    """Every group's shard against single placements; runs are cut, looked up and written in several pieces."""
    import hashlib

    monkeypatch.setattr(sharding, "PLACES", 4)
    monkeypatch.setattr(sharding, "CUT", 3)
    monkeypatch.setattr(sharding, "RUNS_AT_ONCE", 7)
    r = random.Random(4)
    texts = [r.choice(["", "same", "x" * 70]) if r.random() < 0.4 else "".join(r.choice("abcü") for _ in range(r.choice([1, 2, 3, 30, 31, 80]))) for _ in range(400)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards, capacity).collect()
    size: dict[str, int] = {}
    for t in texts:
        size[t] = size.get(t, 0) + len(t.encode()) + 8
    order = sorted(size, key=lambda t: (-size[t], hashlib.sha256(t.encode()).digest()))
    want = dict(zip(order, fit_one_by_one([size[t] for t in order], capacity or -(-sum(size.values()) // shards), shards), strict=True))
    assert {x.doc_id: x.shard for x in rows} == {i: want[t] for i, t in enumerate(texts)}


def test_capacity_mode(spark, odd):
    rows = sharding.shard_documents(odd, None, capacity=500).toPandas()
    full = rows.groupby("shard")["size"].sum()
    biggest = rows.groupby(["shard", "text_crc32"])["size"].sum().groupby("shard").max()
    assert len(rows) == odd.count() and ((full <= 500) | (full == biggest)).all()


def test_winnowing_whole(spark):
    """Edited text and likeness against plain Python, from the fingerprints themselves."""
    import hashlib

    r = random.Random(3)
    rows = [(i * 2, " ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(r.choice([0, 3, 30, 90])))) for i in range(30)] + [(61, None), (63, "日本語 text ü" * 9)]
    got = {x.doc_id: x for x in winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edits = []
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edits.append((i, t[: len(t) - cut] + after[:cut]))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edits[-1][1].encode()).hexdigest())
    own = {x.doc_id: x.fingerprint for x in winnowing.edited_fingerprints(spark.createDataFrame(edits, "doc_id long, text string")).collect()}
    hashes = lambda f: {x.split("@")[0] for x in f.split()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, _), (j, _) in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert got[i].edited_fingerprint == own[i]
        assert math.isclose(got[i].near_edited, alike(hashes(got[i].fingerprint), hashes(own[i]))) and math.isclose(got[i].near_next, alike(hashes(got[i].fingerprint), hashes(got[j].fingerprint)))


@pytest.mark.parametrize(("min_share", "ratio"), [(0.0, 0.0), (1e-5, 0.25)])
def test_language_filters_equal_plain_sets_of_grams(spark, min_share, ratio):
    """Predictions against Python sets of 4-grams: with all grams of each language, and with the cuts that are the default."""
    from collections import Counter

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        s = "_" + "".join(w + "_" for w in words)
        return [s[i : i + 4] for i in range(len(s) - 3)] if words else []

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    odd = [(-1, None, "Ärger über Öl"), (-2, None, "a"), (-3, None, "x y z"), (-4, None, "日本語のテキスト"), (-5, None, "12 34"), (-6, None, None), (-7, "en", "the\U0001f600the 'tis"), (-8, None, "ſtraße İstanbul")]
    d = d.unionByName(spark.createDataFrame(odd, "doc_id long, lang string, text string"))
    rows = d.collect()
    counts = {}
    for r in rows:
        if r.lang is not None and not (r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1):
            counts.setdefault(r.lang, Counter()).update(plain(r.text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = {x: {g: n / total[x] for g, n in c.items() if n / total[x] >= min_share} for x, c in counts.items()}
    top = Counter()
    for of in share.values():
        for g, s in of.items():
            top[g] = max(top[g], s)
    sets = {x: {g for g, s in of.items() if s >= ratio * top[g]} for x, of in share.items()}
    model = langid.train(d.where("doc_id < 0 or crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), min_share, ratio)
    assert model.langs == sorted(counts, key=lambda x: (-total[x], x))
    clear = 0
    for r in langid.predict(d, model).collect():
        g = plain(r.text)
        if not any(c.isalpha() for c in (r.text or "").lower()):
            assert (r["_lang_pred"], r["_lang_score"]) == ("und", 0.0)
            continue
        held = {x: sum(t in s for t in g) / max(len(g), 1) for x, s in sets.items()}
        best = sorted(held.values())
        # a filter adds false positives, of which the expected number is taken off again
        slack = 0.02 + 3 * (0.01 / max(len(g), 1)) ** 0.5
        assert abs(r["_lang_score"] - best[-1]) <= slack, (r.doc_id, r["_lang_score"], held)
        if best[-1] - best[-2] > 2 * slack:
            assert r["_lang_pred"] == max(held, key=held.get)
            clear += 1
    assert clear > 150
