"""Mixing sources to target weights by iterative proportional fitting (raking), without Python code
on the rows.

Tokens are counted per (source, lang, topic) cell. Raking scales the cells in turn until the
sums by source, by language and by topic are the targets within a tolerance, or the rounds are over. A cell's
raked over its counted tokens is the weight of its documents. Each is kept with probability min(1, rate * weight), with
the rate at which the expected kept tokens are ``volume`` of all (or all that have a weight, if these are fewer).
So rare cells don't set how much of the rest stays: those that reach 1 are kept whole and fall short of their
target shares, as nothing is repeated; ``fit`` gives the shares reached and the error that raking left. The draw is a hash of the document id and a seed: the same on every run and after lost executors.

Default targets are tempered shares: a value's share of tokens to the power ``temper``, normalised. Each margin may
be given instead as a DataFrame (value, share); values that it leaves out get share 0 and
their documents are not kept. Without a topic column, ``topic`` (any Column) sorts texts by form.

Cases. Null source, language and topic are values of their own. A null or empty text has one token
(no cell has weight 0). Repeated rows count each; rows with equal ids are kept or dropped
together. Ties in a draw do not occur: a document is kept if its number is below its cell's probability. Very long texts are counted
to their end. An empty table gives no rows. ``sample`` gives other columns back unchanged, whatever their names; ``mix`` adds columns
(OWN), and those of the table named like them give way.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named

MARGINS = ("_mix_source", "_mix_lang", "_mix_topic")
OWN = (*MARGINS, "_mix_tokens", "_mix_weight", "_mix_probability", "_mix_kept")


class Fit(NamedTuple):
    cells: DataFrame  #: the margins' values, tokens, raked, _mix_weight, _mix_probability
    margins: DataFrame  #: margin, value, target, raked and reached (shares of raked and of expected kept tokens)
    error: float  #: largest distance of a raked from a target share
    rate: float


def n_tokens(text: Column) -> Column:
    """Words, at least 1: runs of spaces end a word."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\S+\s*", "w"))).cast("double")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic from the text's form: notes, articles, treatises, and lists of symbols."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#$%&*]+", ""))
    return F.when(symbols > 0.3 * tokens, "symbols").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("treatise")


def coded(value: Column) -> Column:
    """A margin's value as text that differs from null's, whatever it is."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def plain(code: Column) -> Column:
    return F.when(code != "", F.substring(code, F.lit(2), F.length(code)))


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The documents' columns as ``_mix_row``, so that no name clashes, and id, tokens and cell."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")) if "doc_id" in docs.columns else F.lit("\0")
    form = topic if topic is not None else form_topic(text, n_tokens(text))
    return docs.select(F.struct(*named(docs.columns)).alias("_mix_row"), key.alias("_mix_id"), n_tokens(text).alias("_mix_tokens"), coded(F.col("source")).alias("_mix_source"), coded(F.col("lang")).alias("_mix_lang"), coded(form).alias("_mix_topic"))


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(value, share): shares to the power ``temper``, normalised."""
    by = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("share"))
    total = by.agg(F.sum("share").alias("total"))
    return by.join(F.broadcast(total)).select(margin, (F.col("share") / F.col("total")).alias("share"))


def shares(cells: DataFrame, targets: dict[str, DataFrame], **sums: Column) -> DataFrame:
    """(margin, value, target, and the named sums over the value's cells)."""
    out = None
    for margin in MARGINS:
        now = cells.groupBy(margin).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
        now = now.join(targets[margin].withColumnRenamed("share", "target"), margin, "full")
        now = now.select(F.lit(margin.removeprefix("_mix_")).alias("margin"), plain(F.col(margin)).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), *(F.coalesce(name, F.lit(0.0)).alias(name) for name in sums))
        out = now if out is None else out.unionByName(now)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """Add ``raked``: the cell's tokens (as a share of all) scaled to the target margins, and give the largest distance
    of a share from its target. Each step is written before the next, as it reads its input twice."""
    total = cells.agg(F.sum("tokens").alias("total"))
    out = materialize(cells.join(F.broadcast(total)).withColumn("raked", F.col("tokens") / F.col("total")).drop("total"))
    error = 0.0
    for _ in range(rounds):
        for margin in MARGINS:
            now = out.groupBy(margin).agg(F.sum("raked").alias("now"))
            scale = now.join(targets[margin], margin, "left").select(margin, F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("scale"))
            out = materialize(out.join(scale, margin).withColumn("raked", F.col("raked") * F.col("scale")).drop("scale"))
        error = shares(out, targets, raked=F.col("raked")).agg(F.max(F.abs(F.col("raked") - F.col("target")))).first()[0] or 0.0
        if error <= tolerance:
            break
    return out, error


def rate_of(cells: DataFrame, volume: float) -> float:
    """The rate at which sum(min(tokens, rate * raked)) is ``volume`` of all tokens, or of those with a weight if fewer.
    It rises from the rate without the bound; the cells that reach it only become more."""
    some = F.col("raked") > 0
    total, most, raked = cells.agg(F.sum("tokens"), F.sum(F.when(some, F.col("tokens"))), F.sum("raked")).first()
    if not raked:
        return 0.0
    goal, rate, n = min(volume * total, most), 0.0, -1
    while True:
        full = some & (F.lit(rate) * F.col("raked") >= F.col("tokens"))
        count, held, rest = cells.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("raked")))).first()
        if count == n or not rest:
            return rate
        rate, n = max(rate, (goal - held) / rest), count


def fit(rows: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = 0.8, rounds: int = 100, volume: float = 0.5, tolerance: float = 1e-4) -> Fit:
    """Weights and probabilities of the cells of rows ``with_cells``."""
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("_mix_tokens").alias("tokens")))
    goals = {}
    for margin in MARGINS:
        given = (targets or {}).get(margin.removeprefix("_mix_"))
        goal = given.select(coded(F.col(given.columns[0])).alias(margin), F.col(given.columns[1]).alias("share")) if given is not None else tempered(cells, margin, temper)
        goals[margin] = materialize(goal)
    raked, error = rake(cells, goals, rounds, tolerance)
    rate = rate_of(raked, volume)
    weight = F.col("raked") / F.col("tokens")
    raked = materialize(raked.withColumns({"_mix_weight": weight, "_mix_probability": F.least(F.lit(1.0), F.lit(rate) * weight)}))
    kept = F.col("tokens") * F.col("_mix_probability")
    both = shares(raked, goals, raked=F.col("raked"), reached=kept)
    return Fit(raked, both.join(F.broadcast(raked.agg(F.sum(kept).alias("_kept")))).withColumn("reached", F.try_divide("reached", "_kept")).drop("_kept"), error, rate)


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temper: float = 0.8, seed: int = 0, rounds: int = 100, volume: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """Every document with ``_mix_weight`` (raked over counted tokens), ``_mix_probability`` and
    ``_mix_kept``, besides its cell and tokens. ``targets``: by margin name (source, lang, topic)."""
    rows = drawn(docs, topic, targets, temper, seed, rounds, volume, tolerance)
    keep = [c for c in docs.columns if c.lower() not in OWN]
    return rows.select(*(F.col("_mix_row").getField(c).alias(c) for c in keep), *(plain(F.col(m)).alias(m) for m in MARGINS), *(c for c in OWN if c not in MARGINS))


def drawn(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temper: float = 0.8, seed: int = 0, rounds: int = 100, volume: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    rows = with_cells(docs, topic)
    raked = fit(rows, targets, temper, rounds, volume, tolerance).cells.select(*MARGINS, "_mix_weight", "_mix_probability")
    draw = F.pmod(F.xxhash64("_mix_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(raked, list(MARGINS), "left").withColumn("_mix_kept", draw < F.col("_mix_probability"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The kept documents with their own columns alone, whatever their names."""
    return drawn(docs, **how).where("_mix_kept").select("_mix_row.*")
