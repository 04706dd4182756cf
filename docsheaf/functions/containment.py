"""Which texts contain which strings, without comparing every text with every string."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.functions.text import let
from docsheaf.session import stored

#: Strings without a whole word inside are looked up by pieces of this many characters, shorter ones by themselves.
GRAM = 3
#: Strings are handled in blocks of about this many bytes, each of which is broadcast and compared with all texts.
BLOCK_BYTES = 16_000_000
#: Pieces are counted in one text out of so many: the counts choose which piece of a string is looked up, and no result
#: hangs on that choice.
COUNTED = 8
_BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """What stands between the marks and blanks of a text; the first and the last may be cut off, or empty."""
    return F.split(text, _BETWEEN, -1)


def inner_words(string: Column) -> Column:
    """Words with a mark or blank on either side: any text that contains the string has them as whole words."""
    return let(words(string), lambda w: F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))))


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """The different runs of characters of a text, for each of the sizes."""

    def of_size(letters: Column, n: int) -> Column:
        starts = F.slice(letters, F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda c, i: F.concat(c, *[F.get(letters, i + k) for k in range(1, n)]))

    return F.array_distinct(let(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), lambda letters: F.concat(*[of_size(letters, n) for n in sizes])))


def containing(texts: DataFrame, keys: Sequence[str], text: str, strings: DataFrame, string: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of texts that contain some of the strings, with `held`: those strings, in an array. Empty strings are in none.

    A text that contains a string has its inner words, or for a string without any its runs of GRAM characters. The texts
    with the rarest of these are candidates, and only they are searched for the string. Keys tell the texts apart; none is
    null.
    """
    keys = list(keys)
    asked = strings.select(F.col(string).alias("string")).filter(F.length("string") > 0).distinct()
    asked = asked.withColumn("inner", inner_words(F.col("string"))).withColumn("by", F.when(F.size("inner") > 0, 0).otherwise(F.least(F.length("string"), F.lit(GRAM))))
    # Inner words, or runs of GRAM characters, of a string take up to some five times its bytes.
    sizes = {r["by"]: r["bytes"] for r in asked.groupBy("by").agg((F.sum(F.octet_length("string")) * 5).alias("bytes")).collect()}  # GRAM + 1 rows at most
    blocks = max(1, -(-sum(sizes.values()) // block_bytes))
    found = [_candidates(texts, keys, text, asked.filter(F.pmod(F.xxhash64("string"), F.lit(blocks)) == k), sorted(sizes)) for k in range(blocks)]
    # A table's size is known, so that few candidates are sent to the texts; else all texts would be shuffled to meet them.
    named = stored(reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.collect_set("string").alias("maybe")))
    held = texts.join(named, keys).withColumn("held", F.filter("maybe", lambda s: F.contains(F.col(text), s)))
    return held.filter(F.size("held") > 0).drop("maybe")


def _candidates(texts: DataFrame, keys: list[str], text: str, asked: DataFrame, kinds: list[int]) -> DataFrame:
    """(keys, string): texts that hold the string's rarest piece. asked: string, inner, by, a block of them."""
    sizes = [k for k in kinds if k]
    by_size = lambda n: F.when(F.col("by") == n, grams(F.col("string"), [n]))
    own = F.coalesce(F.when(F.col("by") == 0, F.transform("inner", lambda w: F.concat(F.lit(" "), w))), *map(by_size, sizes))
    parts = ([F.transform(words(F.col(text)), lambda w: F.concat(F.lit(" "), w))] if 0 in kinds else []) + ([grams(F.col(text), sizes)] if sizes else [])
    pieces = asked.select("string", F.explode(own).alias("piece"))
    spelled = lambda some: some.select(*keys, F.explode(F.array_distinct(F.concat(*parts))).alias("piece"))
    counted = spelled(texts.filter(F.pmod(F.xxhash64(*keys), F.lit(COUNTED)) == 0))
    common = counted.join(F.broadcast(pieces.select("piece").distinct()), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n_texts"))
    # Of pieces that weren't met, the longest is the likeliest to be rare.
    order = F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), (-F.length("piece")).alias("short"), "piece")
    chosen = pieces.join(F.broadcast(common), "piece", "left").groupBy("string").agg(F.min(order)["piece"].alias("piece"))
    return spelled(texts).join(F.broadcast(chosen), "piece").select(*keys, "string")
