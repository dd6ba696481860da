"""Toxicity, conversation repair and hard negatives: against brute force, on awkward tables, and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import edits, negatives, toxicity

SF = "/root/testdata/sf0.01"


# toxicity


def test_gradient_is_that_of_the_noisy_or_loss():
    r = np.random.default_rng(1)
    bag, toxic, weight = np.array([0, 0, 1, 2, 2, 2]), np.array([True, False, True]), np.array([1.0, 2.5, 1.0])

    def loss(z):
        p, _ = toxicity.noisy_or(z, bag, 3)
        return -(weight * np.where(toxic, np.log(p), np.log1p(-p))).sum()

    z = r.normal(size=6)
    for i in range(6):
        up, down = z.copy(), z.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert math.isclose((loss(up) - loss(down)) / 2e-6, toxicity.gradient(z, bag, toxic, weight)[i], rel_tol=1e-4)
    one = 1 / (1 + np.exp(-z))
    assert np.allclose(toxicity.noisy_or(z, bag, 3)[0], [1 - np.prod(1 - one[bag == k]) for k in range(3)])


def test_the_planted_sentences_are_found(spark):
    """One in ten documents has one sentence with one of five words; labels name documents only."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(n))
    docs, labels, place = [], [], {}
    for i in range(1500):
        parts = [say(8) for _ in range(r.randrange(1, 12))]
        bad = i % 10 == 0
        if bad:
            at = r.randrange(len(parts))
            parts[at] += " " + r.choice("zork blug fnord grak mump".split()) + " " + say(3)
            place[i] = sum(len(p) + 2 for p in parts[:at])
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predict(d, toxicity.train(d, lab.where(~toxicity.is_held_out()))).collect()
    assert all((x["_tox_score"] >= 0.5) == (x.doc_id % 10 == 0) for x in got)
    for x in got:
        if x.doc_id % 10 == 0:
            (span,) = x["_tox_spans"]
            assert span.start <= place[x.doc_id] + 1 and span.end > place[x.doc_id]
        else:
            assert x["_tox_spans"] == []


def test_held_out_accuracy(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, lab.where(~toxicity.is_held_out()))
    out = toxicity.predict(d.join(lab.where(toxicity.is_held_out()), "doc_id"), model)
    n = {(x.toxic, x.hit): x["count"] for x in out.groupBy("toxic", (F.col("_tox_score") >= 0.5).alias("hit")).count().collect()}
    assert n[1, True] >= 0.85 * (n[1, True] + n[1, False]) and n.get((0, True), 0) <= 0.01 * n[0, False]


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "bad words here. fine", "x"), (1, "bad words here. fine", "x"), (2, None, "x"), (3, "", "x"), (None, "bad bad", "x"), (4, "12 34 !?", "x"), (5, "so " * 200_000, "x"), (6, "퟿ 日本。", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _TOX_score string")
    lab = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, None), (6, 7), (None, 1)], "doc_id long, toxic int")
    got = toxicity.predict(d, toxicity.train(d, lab)).collect()
    assert len(got) == 8 and all(0 <= x["_tox_score"] <= 1 for x in got) and len({c.lower() for c in got[0].asDict()}) == 4
    assert {x["_tox_score"] for x in got if x.doc_id in (2, 3, 4)} == {0.0}
    for none in (lab.limit(0), lab.where("toxic = 1"), lab.where("toxic = 0")):
        assert all(x["_tox_score"] == 0.0 for x in toxicity.predict(d, toxicity.train(d, none)).collect())
    assert toxicity.predict(d.limit(0), toxicity.train(d, lab)).count() == 0
    assert [w for _, _, w in toxicity.sentences("a b. c!\nd")] == [["a", "b"], ["c"], ["d"]] and len(list(toxicity.sentences("so " * 130))) == 3


# conversation repair

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
PUT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def every_repair(rows):
    """Least (cost, audit, lines) of all sequences of edits of rows (kind, role, text); up to two turns put in at a place."""
    best = None
    todo = [(0, "", 0, "", ())]
    while todo:
        at, state, cost, audit, lines = todo.pop()
        if best is not None and cost > best[0]:
            continue
        if at == len(rows) and state in ("", "a"):
            best = min(x for x in (best, (cost, audit, lines)) if x is not None)
        if not audit.endswith("II"):
            todo.append((at, PUT[state][0], cost + 2, audit + "I", (*lines, PUT[state] + ":")))
        if at < len(rows):
            kind, role, text = rows[at]
            todo.append((at + 1, state, cost + 3, audit + "D", lines))
            if kind not in ("b", "d"):
                more = kind == "t"
                todo.append((at + 1, PUT[state][0], cost + 2 + more, audit + "R", (*lines, f"{PUT[state]}:{text}")))
                if (state, role[:1]) in AFTER:
                    todo.append((at + 1, AFTER[state, role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}")))
    return best


def told(rows):
    """The result for a conversation's rows (turn, role, text) after the damage, in order, by its definition."""
    seen, kinds = set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\f\r")
        kinds.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    i = [r[:1] for _, r, _ in rows]
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:], strict=False))], kinds


def hurt(rows):
    """{conv: rows after the damage, in order} of (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        luck = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if luck:
            role, text = "user" if luck == 4 else role, {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(luck, text)
            mine += [(turn, role, text)] * (2 if luck == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def check_repair(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, kind string")
        got = {(None if x.conv == edits.NULL_KEY else x.conv): x for x in edits.repair(edits.damaged(df)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = hurt(rows)
    assert set(got) == set(want)
    return got, want


def test_repair_is_the_least_of_all(spark):
    r = random.Random(3)
    rows = []
    for conv in [None, *range(120)]:
        n = r.randrange(0, 6)
        rows += [(conv, r.choice([t, t, t + 1, None]), r.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]), r.choice(["Hi.", "Why?", "so", "go on", " \n", "", None])) for t in range(n)]
    got, want = check_repair(spark, rows, 7)
    for conv, mine in want.items():
        counts, kinds = told(mine)
        cost, audit, lines = every_repair([(k, role, text) for k, (_, role, text) in zip(kinds, mine, strict=True)])
        x = got[conv]
        assert [x.gaps, x.blank, x.duplicate, x.truncated, x.illegal] == counts
        assert (x.cost, x.audit, x.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_long_conversations_are_cut(spark):
    """Conversations over several partitions equal those in one; one repeats a row over partitions."""
    r = random.Random(4)
    rows = [(7, t, r.choice(["system", "user", "assistant"]), r.choice([f"Line {t}.", f"line {t}", "again.", "x" * 5000 + "."])) for t in range(900)]
    rows += [(8, 5, "user", "same.")] * 400 + [(9, None, "user", f"t{i}") for i in range(300)] + [(i, 1, "user", "Q?") for i in range(10, 40)]
    cut, want = check_repair(spark, rows, 9)
    one, _ = check_repair(spark, rows, 1)
    assert {c: tuple(x) for c, x in cut.items()} == {c: tuple(x) for c, x in one.items()}
    for conv, mine in want.items():
        x = one[conv]
        assert [x.gaps, x.blank, x.duplicate, x.truncated, x.illegal] == told(mine)[0]
    assert one[8].audit == "D" * (len(want[8]) - 1) or one[8].cost <= 3 * len(want[8])


def test_cut_runs_fold_to_the_whole():
    r = random.Random(6)
    for _ in range(300):
        items = [(r.choice(["", "t", "d", "b"]), r.choice(["s", "u", "a", "x", ""])) for _ in range(r.randrange(9))]
        at = [0, *sorted(r.randrange(len(items) + 1) for _ in range(3)), len(items)]
        runs = []
        for a, b in itertools.pairwise(at):
            runs.append(edits.Run())
            for kind, role in items[a:b]:
                runs[-1].add(None, role, "t", kind)
        tables = [{"part": i, "table": [dict(zip(("begin", "end", "cost", "place"), t, strict=True)) for t in x.table(i == 3)]} for i, x in enumerate(runs)]
        parts = [x.repaired(b, (e,), p == 3) for (p, b, e), x in zip(edits.fold(tables), runs, strict=True)]
        whole = every_repair([(k, role, "t") for k, role in items])
        assert (sum(c for c, _, _ in parts), "".join(a for _, a, _ in parts)) == whole[:2]


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert edits.repair(edits.damaged(none)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (x,) = edits.repair(edits.damaged(spark.createDataFrame([(1, gone, "user", "hi")], none.schema))).collect()
    assert tuple(x) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# hard negatives


def mined(rows, is_anchor, k, take, low, high):
    whole = {}
    for n, (i, label, e) in enumerate(rows):
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e):
            whole[n] = (i, label, [math.floor(256 * x) for x in e])
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a in {x[0] for x in whole.values() if is_anchor(x[0])}:
        _, label, mine = min(x for x in whole.values() if x[0] == a)
        score = [(-clip(sum(p * q for p, q in zip(mine, e, strict=False))), i, own == label) for i, own, e in whole.values() if i != a]
        for p, pid, same in sorted(x for x in score if x[2])[:k]:
            fit = sorted(x for x in score if not x[2] and low * -p <= 100 * -x[0] <= high * -p)[:take]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("giant", [False, True])
def test_hard_negatives_by_hand(spark, monkeypatch, giant):
    """Several trees, blocks and rounds; close and far anchors, ties, repeated rows, rows that take no part."""
    for name, n in (("BLOCK", 16), ("TREE", 8), ("STRIP", 7)):
        monkeypatch.setattr(negatives, name, n)
    r = np.random.default_rng(2)
    centre = r.normal(size=(4, 6))
    e = np.round((centre[r.integers(0, 4, 150)] + 0.1 * r.normal(size=(150, 6))) * 16) / 16
    rows = [(i, int(r.integers(0, 3)), [float(x) for x in e[i]]) for i in range(150)]
    rows += [rows[10], rows[11], (11, 2, [9.0] * 6), (200, None, [1.0] * 6), (201, 1, None), (202, 1, [None] * 6), (203, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (205, 1, []), (210, 9, [1.0, 1.0])]
    if giant:
        rows += [(301, 1, [1e15] * 6), (310, 1, [1e16, -1e16, 1.0, 0.0, 2.0, 0.0]), (302, 2, [7e15] * 6), (303, 2, [1e300] * 6)]
        rows = [(i, lab, None if v is None else [x if x is None or not math.isfinite(x) else max(-(2.0**54), min(2.0**54, x)) for x in v]) for i, lab, v in rows]
    df = spark.createDataFrame([(*x, "n", 0.5) for x in rows], "vec_id long, label int, embedding array<double>, tree string, score double")
    for pick in (lambda i: i % 5 == 0, lambda i: i % 3 < 2):
        got = sorted(map(tuple, negatives.hard_negatives(df, pick, 3, 4, 30, 90).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
        if giant:
            got = [x for x in got if max(abs(x[4]), abs(x[5])) < 2**62]
        want = [x for x in mined(rows, pick, 3, 4, 30, 90) if not giant or max(abs(x[4]), abs(x[5])) < 2**62]
        assert got == want and len(got) > 50


def test_hard_negatives_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(none, lambda i: i % 5 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], none.schema)
    assert negatives.hard_negatives(one, lambda i: i % 5 == 0).count() == 0 and negatives.hard_negatives(one, lambda i: i > 0).count() == 0


def test_spanning_tree_is_least():
    r = np.random.default_rng(4)
    for _ in range(20):
        v = r.normal(size=(5, 3))
        order, parent, far = negatives.spanning_tree(v)
        seen = set()
        for i in order:
            assert parent[i] < 0 or int(parent[i]) in seen
            seen.add(int(i))
        edges = list(itertools.combinations(range(5), 2))
        length = {x: np.linalg.norm(v[x[0]] - v[x[1]]) for x in edges}

        def joined(tree):
            group = list(range(5))
            for a, b in tree:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
            return len(set(group)) == 1

        assert math.isclose(far.sum(), min(sum(length[x] for x in t) for t in itertools.combinations(edges, 4) if joined(t)))


# chat formatting, by the costs that its docstring states


def chat_costs(roles):
    """Least cost of every way to keep, merge, relabel or put empty turns before turns, and to close the conversation."""
    follows = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def close(state, cost, depth=0):
        if state == "assistant":
            return cost
        if depth == 3:
            return math.inf
        return min(close(x, cost + 3, depth + 1) for x in follows[state])

    def go(state, rest):
        if not rest:
            return close(state, 0)
        role, after = rest[0], rest[1:]
        ways = [go(x, after) + (0 if x == role else 2) for x in follows[state]]
        if state != "start":
            ways.append(go(state, after) + (1 if role == state else 3))
        ways += [go(role, after) + 3 for x in follows[state] if role in follows.get(x, ())]
        return min(ways)

    return go("start", tuple(roles))


def rendered_cost(rows, roles):
    """What a repair costs by its rows (turn, seq, role, action, rendered)."""
    cost = 0
    for i, (turn, seq, role, action, text) in enumerate(rows):
        if seq == 1:
            cost += {"keep": 0, "relabel": 2}.get(action, 1 if roles[turn] == role else 3)
        else:
            cost += 3 * (text.count("<|end|>\n<|") if seq == 2 else 1)
    return cost


def test_chat_repair_costs_what_the_docstring_says(spark):
    from ledgerloom.llm import chat

    rows, want = [], {}
    for n in (1, 2, 3, 4):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            conv = len(want)
            want[conv] = (roles, chat_costs(roles))
            rows += [(conv, t, role, "x") for t, role in enumerate(roles)]
    got = {}
    for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.seq, x.role, x.action, x.rendered))
    for conv, (roles, cost) in want.items():
        assert rendered_cost(sorted(got[conv]), roles) == cost, roles


def test_chat_on_odd_rows(spark):
    """Null and unknown roles, null texts, turns and conversations, repeated rows, a long text, a conversation over partitions, clashing names."""
    from ledgerloom.llm import chat

    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "tool", ""), (None, None, "user", "a"), (None, 3, "user", "b"), (2, 0, "user", "x" * 300_000), *((3, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(400))]
    df = spark.createDataFrame([(*r, 9, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, part int, action string, seq int").repartition(5)
    got = chat.format_chats(df).collect()
    text = {}
    for x in sorted(got, key=lambda x: (x.conv_id is not None, x.conv_id or 0, x.turn is not None, x.turn or 0, x.seq)):
        text[x.conv_id] = text.get(x.conv_id, "") + x.rendered
    assert sum(x.seq == 1 for x in got) == len(rows) and set(text) == {None, 1, 2, 3}
    assert text[3] == "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\nt{t}<|end|>\n" for t in range(400))
    assert len(text[2]) > 300_000 and all(t.endswith("<|end|>\n") for t in text.values())
    assert chat.format_chats(df.limit(0)).count() == 0


# words of any length


def test_long_words_differ(spark):
    """Words of over 64 Ki bytes that only exchange bytes that far apart."""
    from ledgerloom.llm import hashing, jaccard_join

    half = 1 << 16
    texts = ["a" * half + "b" * half, "b" * half + "a" * half, "a" * half + "b" * half + "a" * 5, "a" * 5 + "b" * half + "a" * half, "ab" * half, "ba" * half]
    words, count = hashing.word_hashes([t.encode() for t in texts])
    assert len(set(words.tolist())) == len(texts) and count.tolist() == [1] * len(texts)
    rows = spark.createDataFrame([*enumerate(texts), (10, texts[0]), (11, texts[1].upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in jaccard_join.jaccard_components(rows, k=4, num=85, den=100).select(jaccard_join.plain_id("key").alias("doc_id"), "component").collect()}
    assert got == {**{i: i for i in range(6)}, 10: 0, 11: 1}
