"""URL filters: domain and path rules, and beyond them a template tree per host.

Rules are strings ``host/path``: one fits its host and all subdomains, if the url's path starts with
the rule's path (from the slash on); the longest fitting rule decides.

The tree. A path's segments become tokens: numbers, long hexadecimal names and their extensions are wildcards at once.
Level by level, down to the longest path, the children of a template node (host, tokens so far) are looked at together:

* Where there are more than ``many`` of them, those with less than the share ``rare`` of the node, but for plain numbers and names, are one wildcard. So at
  most ``many`` children, or 1 / rare, are left to compare, however many urls the node has.
* Of these, a child joins the first of the larger ones' groups that it is like: their next tokens (over 64 hash buckets) differ
  by no more than a Hoeffding bound for the smaller (total variation), and so do their purities. A group of several is
  one branch, ``{a|b}``.

Labels are the verdicts of the rules, and a path's labels count over all hosts: where rules judge ``/de/{n}`` on some
hosts, this tells of ``/de/{n}`` elsewhere. A path's purity is the share of blocked among the labelled urls of this token path
on all hosts, smoothed towards ``prior`` by ``weight`` counts; a template's is the share of blocked among its own labelled urls, smoothed by
``weight`` counts towards the mean of its paths' purities. From ``reject`` on, urls without a rule under this
template are blocked, else allowed. All of it is counted over distinct (host, tokens), aggregated over all urls.

Cases. A null url, or one without ``://``, has empty host and path; it counts under the empty host's
templates. Very long paths are read to their end: a level costs a pass over the paths that go on there and share their template. Ties in
size go by token. Repeated rows count each. An empty table gives no rows. Other columns go through; those named like one that is
added here give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_of, materialize, named

#: Capitals that hosts lower.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 64
OWN = ("_url_host", "_url_path", "_url_rule", "_url_template", "_url_purity", "_url_verdict")


def host_of(url: Column) -> Column:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. rules: {rule: verdict}."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def tokens_of(path: Column) -> Column:
    """Segments as tokens."""
    token = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+", "{n}"), r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}", "{x}")
    return F.transform(F.filter(F.split(path, "/"), lambda s, i: i > 0), token)


def smoothed(block: Column, allow: Column, to: Column, weight: float) -> Column:
    return (block + F.lit(weight) * to) / (block + allow + F.lit(weight))


def grouped(children: list[tuple[str, int, float, np.ndarray]], delta: float) -> dict[str, str]:
    """{token: step} of a node's children (token, n, purity, bucket counts): the names of their groups."""
    groups: list[tuple[list[str], int, float, np.ndarray]] = []
    for tok, n, purity, counts in sorted(children, key=lambda c: (-c[1], c[0])):
        bound = min(0.5, float(np.sqrt(np.log(2 / delta) / (2 * n))))
        for i, (toks, m, p, total) in enumerate(groups):
            if abs(p - purity) <= bound and np.abs(total / m - counts / n).sum() / 2 <= bound:
                groups[i] = ([*toks, tok], m + n, (p * m + purity * n) / (m + n), total + counts)
                break
        else:
            groups.append(([tok], n, purity, counts))
    return {t: toks[0] if len(toks) == 1 else "{" + "|".join(sorted(toks)) + "}" for toks, *_ in groups for t in toks}


def merged(nodes: DataFrame, delta: float) -> DataFrame:
    """nodes (host, template, children: tok, n, purity, kinds: bucket and count) to (host, template, tok, step)."""

    def go(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                children = []
                for c in r["children"]:
                    counts = np.zeros(BUCKETS)
                    for kind in c["kinds"]:
                        counts[kind["bucket"]] = kind["c"]
                    children.append((c["tok"], c["n"], c["purity"], counts))
                out += [(r["host"], r["template"], tok, step) for tok, step in grouped(children, delta).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string(), pa.string()))], ["host", "template", "tok", "step"])

    return nodes.mapInArrow(go, "host string, template array<string>, tok string, step string")


def generalise(paths: DataFrame, many: int, rare: float, delta: float) -> DataFrame:
    """paths (host, tokens, n, purity) with ``template``, an array of tokens, added."""
    node = ["host", "template"]
    open_, done, depth = paths.withColumn("template", F.array().cast("array<string>")), None, 0
    while True:
        # a path alone in its node has nothing to be compared with: its tokens are its template
        alone = open_.groupBy(*node).agg((F.count("*") == 1).alias("_alone"))
        rows = materialize(open_.join(alone, node))
        rest = F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(0)))
        ended = (F.size("tokens") <= depth) | F.col("_alone")
        here = rows.where(ended).withColumn("template", F.concat("template", rest)).drop("_alone")
        done = here if done is None else done.unionByName(here)
        open_ = rows.where(~ended).drop("_alone").withColumns({"tok": F.get("tokens", F.lit(depth)), "nxt": F.coalesce(F.get("tokens", F.lit(depth + 1)), F.lit(""))})
        if not open_.take(1):
            return done
        kinds = open_.groupBy(*node, "tok", F.pmod(F.xxhash64("nxt"), F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("purity")).alias("p"))
        child = kinds.groupBy(*node, "tok").agg(F.sum("c").alias("n"), (F.sum("p") / F.sum("c")).alias("purity"), F.collect_list(F.struct("bucket", "c")).alias("kinds"))
        size = child.groupBy(*node).agg(F.sum("n").alias("total"), F.count("*").alias("of"))
        child = materialize(child.join(size, node).withColumn("rare", (F.col("of") > many) & (F.col("n") < rare * F.col("total")) & ~F.col("tok").isin("{n}", "{x}")))
        frequent = child.where("not rare").groupBy(*node).agg(F.collect_list(F.struct("tok", "n", "purity", "kinds")).alias("children"))
        steps = merged(frequent, delta).unionByName(child.where("rare").select(*node, "tok", F.lit("{*}").alias("step")))
        open_ = materialize(open_.join(steps, [*node, "tok"]).withColumn("template", F.concat("template", F.array("step"))).drop("tok", "nxt", "step"))
        depth += 1


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", many: int = 20, rare: float = 0.05, delta: float = 0.05, prior: float = 0.25, weight: float = 2.0, reject: float = 0.7) -> DataFrame:
    """Add ``_url_host``, ``_url_path``, ``_url_rule``, ``_url_template``, ``_url_purity`` and ``_url_verdict``."""
    pages = free_of(pages, *OWN, "_url_tokens")
    rows = pages.withColumns({"_url_host": host_of(F.col(url)), "_url_path": path_of(F.col(url))})
    rows = rows.withColumns({"_url_rule": rule_of(F.col("_url_host"), F.col("_url_path"), rules), "_url_tokens": tokens_of(F.col("_url_path"))})
    blocked = F.col("_url_rule").isin([r for r, v in rules.items() if v == "block"])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paths = rows.groupBy(F.col("_url_host").alias("host"), F.col("_url_tokens").alias("tokens"))
    paths = materialize(paths.agg(F.count("*").alias("n"), count(blocked).alias("b"), count(~blocked).alias("a")))
    known = paths.groupBy("tokens").agg(smoothed(F.sum("b"), F.sum("a"), F.lit(prior), weight).alias("of_path"))
    paths = paths.join(known, "tokens").withColumn("purity", smoothed(F.col("b"), F.col("a"), F.col("of_path"), weight))
    found = materialize(generalise(materialize(paths), many, rare, delta))
    mean = F.sum(F.col("n") * F.col("of_path")) / F.sum("n")
    pure = found.groupBy("host", "template").agg(smoothed(F.sum("b"), F.sum("a"), mean, weight).alias("_url_purity"))
    found = found.join(pure, ["host", "template"]).select(F.col("host").alias("_url_host"), F.col("tokens").alias("_url_tokens"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("_url_template"), "_url_purity")
    out = rows.join(materialize(found), ["_url_host", "_url_tokens"])
    by_rule = F.when(blocked, "block").when(F.col("_url_rule").isNotNull(), "allow")
    return out.withColumn("_url_verdict", F.coalesce(by_rule, F.when(F.col("_url_purity") >= reject, "block").otherwise("allow"))).select(*named(pages.columns), *OWN)
