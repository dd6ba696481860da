"""Token-sort similarity of names, 0 to 100, in built-in functions, and a join of names by it.

The join (``similar``) compares few pairs. A longest common subsequence is no longer than what two names have in common as bags of
characters. A bag is a set of (character, how often it came before), in one order for all names, rare ones first. For a
similarity of t, the names' lengths x and y (y least) and their common part c have c >= t (x + y) / 200 and y >= x t / (200 - t), so both
have one of their first x - x t / (200 - t) + 1 marks in common (the prefix of each). An inverted index has the prefixes; pairs it finds are
compared if their lengths and then their whole bags allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import materialize

#: Characters of the first name in one number of the state.
WORD = 60
ONES = (1 << WORD) - 1


def sorted_tokens(name: Column) -> Column:
    """Lower-cased tokens in order, joined by a space."""
    tokens = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def let(value: Column, body) -> Column:
    """Bind a value once inside one expression, so that lambdas below don't evaluate it again."""
    return F.transform(F.array(value), body)[0]


def profile(name: Column) -> Column:
    """What a comparison needs of a name: sorted tokens ``w``, their characters, and, for up to WORD of them, bits of the places
    of each character."""

    def of(w: Column) -> Column:
        chars = F.filter(F.split(w, ""), lambda c: c != "")
        bits = lambda cs, c: F.aggregate(F.transform(cs, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
        places = lambda cs: F.map_from_entries(F.transform(F.array_distinct(F.slice(cs, 1, WORD)), lambda c: F.struct(c.alias("key"), bits(F.slice(cs, 1, WORD), c).alias("value"))))
        return let(chars, lambda cs: F.struct(w.alias("w"), F.size(cs).alias("n"), cs.alias("chars"), places(cs).alias("places")))

    return let(sorted_tokens(name), of)


def common_short(places: Column, chars: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel, of a name of up to WORD characters, by their places, and another.

    Bit i of the state is 0 where the subsequence grows at the first name's character i.
    """

    def step(s: Column, c: Column) -> Column:
        m = F.coalesce(F.try_element_at(places, c), F.lit(0).cast("long"))
        return let(s.bitwiseAND(m), lambda u: (s + u).bitwiseOR(s - u).bitwiseAND(F.lit(ONES)))

    return F.lit(WORD) - F.bit_count(F.aggregate(chars, F.lit(ONES), step))


def places_from(a: Column, first: Column, c: Column) -> Column:
    """Bits of the places of ``c`` among the WORD characters of ``a`` from ``first`` (from 0) on."""
    bits = F.transform(F.slice(a, first + 1, F.lit(WORD)), lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def common_long(a: Column, b: Column) -> Column:
    """The same of two arrays of characters of any length: a state of several numbers, with the sum's carry from each to the next."""
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / WORD).cast("int"))
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        def word(done: Column, w: Column) -> Column:
            here = F.struct(F.get(state, w).alias("s"), places_from(a, w * WORD, c).alias("m"))
            grown = let(here, lambda x: F.struct((x["s"] + x["s"].bitwiseAND(x["m"]) + done["carry"]).alias("sum"), x["s"].bitwiseAND(F.bitwise_not(x["m"])).alias("kept")))
            return let(grown, lambda x: F.struct(F.shiftright(x["sum"], WORD).alias("carry"), F.concat(done["out"], F.array(x["sum"].bitwiseAND(F.lit(ONES)).bitwiseOR(x["kept"]))).alias("out")))

        return F.aggregate(words, empty, word, lambda x: x["out"])

    state = F.aggregate(b, F.transform(words, lambda w: F.lit(ONES)), step)
    return F.aggregate(state, F.lit(0), lambda n, s: n + WORD - F.bit_count(s))


def likeness(x: Column, y: Column) -> Column:
    """(1 - dist / n) * 100 of two profiles, dist = n - 2 * common, n the total length; 100 for two empty names."""
    n = x["n"] + y["n"]
    common = F.when(x["n"] <= WORD, common_short(x["places"], y["chars"])).when(y["n"] <= WORD, common_short(y["places"], x["chars"])).otherwise(common_long(x["chars"], y["chars"]))
    return F.when(x["w"] == y["w"], 100.0).otherwise((1 - (n - 2 * common) / F.greatest(n, F.lit(1)).cast("double")) * 100)


def similarity(a: Column, b: Column) -> Column:
    return let(F.struct(profile(a).alias("x"), profile(b).alias("y")), lambda p: likeness(p["x"], p["y"]))


#: Least similarities that the index is made for: a probe takes the next below what it needs.
BANDS = (98, 95, 90, 85, 80, 75, 70, 60, 50, 35)


def band(least: Column) -> Column:
    """The greatest of BANDS up to the similarity that is needed, at least the last."""
    out = F.lit(BANDS[-1])
    for b in reversed(BANDS[:-1]):
        out = F.when(least >= b, b).otherwise(out)
    return out


def marks(chars: Column) -> Column:
    """Each character with how often it came before; of an empty name one empty mark."""
    own = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i), lambda x: x == c)).cast("string")))
    return F.when(F.size(chars) > 0, own).otherwise(F.array(F.lit("")))


def similar(probes: DataFrame, words: DataFrame) -> DataFrame:
    """probes (side, a, least) and words (side, name), distinct and with sorted tokens, to (side, a, name, s): all pairs of a
    similarity s of at least ``band(least)``."""
    return compared(candidates(probes, words))


def candidates(probes: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (side, a, name, band) that the index and the filters leave."""
    probes = probes.withColumn("band", band(F.col("least"))).drop("least")
    every = probes.select(F.col("a").alias("w")).unionByName(words.select(F.col("name").alias("w"))).distinct()
    every = materialize(every.withColumn("mark", F.explode(F.transform(marks(F.filter(F.split("w", ""), lambda c: c != "")), lambda m: F.xxhash64(m)))))
    often = every.groupBy("mark").agg(F.count("*").alias("n"))
    bags = every.join(often, "mark").groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "mark"))), lambda x: x["mark"]).alias("bag"))
    bags = materialize(bags.withColumn("n", F.length("w")))
    least = lambda n: F.ceil(n * F.col("band") / (200 - F.col("band")) - 1e-9).cast("int")
    prefix = lambda c: F.slice(f"{c}.bag", F.lit(1), F.greatest(F.lit(1), F.col(f"{c}.n") - least(F.col(f"{c}.n")) + 1))
    of = lambda df, c, z: df.join(bags.select(F.col("w").alias(c), F.struct("n", "bag").alias(z)), c)
    asked = of(probes, "a", "x").withColumn("first_x", prefix("x"))
    bands = probes.select("side", "band").distinct()  # at most as many as BANDS of each side
    held = of(words, "name", "y").join(F.broadcast(bands), "side").withColumn("first_y", prefix("y"))
    both = F.col("band") * (F.col("x.n") + F.col("y.n"))
    pairs = asked.withColumn("mark", F.explode("first_x")).join(held.withColumn("mark", F.explode("first_y")), ["side", "band", "mark"])
    pairs = pairs.where((200 * F.least("x.n", "y.n") >= both) & (F.get(F.array_intersect("first_x", "first_y"), F.lit(0)) == F.col("mark")))
    return pairs.where(200 * F.size(F.array_intersect("x.bag", "y.bag")) >= both).select("side", "a", "name", "band")


def compared(pairs: DataFrame) -> DataFrame:
    """Those that are similar enough, with the similarity; each pair of names is compared once."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs)
    one = pairs.select("a", "name").distinct().repartition(parts)
    of = lambda c: pairs.select(c).distinct().withColumn(f"{c}_p", profile(F.col(c)))
    one = one.join(of("a"), "a").join(of("name"), "name").select("a", "name", likeness(F.col("a_p"), F.col("name_p")).alias("s"))
    return pairs.join(one, ["a", "name"]).where("s >= band").select("side", "a", "name", "s")
