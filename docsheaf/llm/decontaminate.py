"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Texts are lower-cased runs of letters and digits. A fixed mask over SPAN tokens ignores one position; hashes of the
tokens that it looks at, at every place of the training texts, meet those of the benchmark. Every hit names a diagonal
(place in the text less place in the item), along which the two are compared token by token, and the best stretch is
scored +1 for an equal and -2 for a differing token, so substitutions around the hits are borne.

A stretch of score s with m differing tokens is s + 3 m tokens long, so it holds s + 3 m - SPAN + 1 windows, of which each
differing token spoils at most the three whose mask looks at it. So at least s - SPAN + 1 windows hit, wherever the
differing tokens are and whether or not the stretch touches an end of the text. Only diagonals with that many hits are
compared, and none that reaches the score is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import bind, saved, text_of

TOKEN = r"[\p{L}\p{N}]+"
#: Places in a window of SPAN tokens that the seed looks at. Three of them, which the count of hits above goes by: as many
#: as a differing token takes from the score in all. Shorter items are hashed whole.
MASK = (0, 1, 3)
SPAN = MASK[-1] + 1
#: The seeds of the SQL alone: masks of 12 tokens as first tokens of the adjacent pairs they look at. They find overlaps
#: that hold such a window and miss others of the same score.
MASKS = ((0, 2, 8, 10), (0, 4, 6, 10), (0, 2, 4, 6))
MISMATCH = -2
MIN_SCORE = 10
#: Items are handled in blocks of about so many seeds, whose hashes are broadcast (some 50 bytes each); every block is
#: compared with all documents.
BLOCK_SEEDS = 1_000_000
#: Hits with their items are broadcast up to this size, and meet the texts in a shuffle beyond.
BROADCAST_BYTES = 64_000_000


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def seeds(tokens: Column, widths: list[int]) -> Column:
    """array<struct<at, width, seed>>: every window of each width, under MASK where it is SPAN wide, else whole."""
    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), lambda hashes: F.concat(*[_windows(hashes, n) for n in widths]))


def _windows(hashes: Column, n: int) -> Column:
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    seed = lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(hashes, i + j) for j in (MASK[1:] if n == SPAN else range(1, n))])
    return F.transform(starts, lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("width"), seed(x, i).alias("seed")))


def _best_stretch(equal: Column) -> Column:
    """The highest sum of consecutive +1 / MISMATCH scores."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + F.when(same, F.lit(1)).otherwise(F.lit(MISMATCH)))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(equal, start, step, lambda acc: acc["best"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_key"), text_of(text_col).alias("text"))


def _candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, item, diagonals array<struct<hits, diagonal>>), most hits first, saved. items: item_id, item."""
    n = F.size("item")
    width = F.least(n, F.lit(SPAN))
    needed = F.least(n, F.lit(MIN_SCORE)) - width + 1
    widths = sorted(r[0] for r in items.select(width).distinct().collect()) or [SPAN]  # SPAN widths at most
    own = items.select("item_id", width.alias("own_width"), needed.alias("needed"), F.explode(seeds(F.col("item"), widths)).alias("s")).filter(F.col("s.width") == F.col("own_width"))
    item_seeds = saved(own.select("item_id", "needed", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")))
    blocks = max(1, -(-item_seeds.count() // BLOCK_SEEDS))

    doc_seeds = texts.select("doc_id", "row_key", F.explode(seeds(tokens_of(F.col("text")), widths)).alias("s")).select("doc_id", "row_key", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    found = []
    for block in range(blocks):
        part = item_seeds.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        met = doc_seeds.join(F.broadcast(part), "seed").select("doc_id", "row_key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "needed")
        # equal rows add up here, which can only let more diagonals through to the comparison
        counted = met.groupBy("doc_id", "row_key", "item_id", "diagonal").agg(F.count(F.lit(1)).alias("hits"), F.min("needed").alias("needed"))
        found.append(counted.filter(F.col("hits") >= F.col("needed")))
    pairs = reduce(DataFrame.unionByName, found).groupBy("doc_id", "row_key", "item_id").agg(F.sort_array(F.collect_list(F.struct("hits", "diagonal")), asc=False).alias("diagonals"))
    named = items.withColumnRenamed("item_id", "own_id")
    return saved(pairs.join(named, F.col("item_id").eqNullSafe(F.col("own_id"))).drop("own_id"))


def _score(words: Column, item: Column, diagonals: Column) -> Column:
    """The best stretch over the diagonals. One with h hits holds no stretch of a score over h + SPAN - 1, so diagonals
    that can't beat the best so far aren't compared: where a text repeats one word, that is all but the first."""

    def stretch(diagonal: Column) -> Column:
        at, item_at = F.greatest(diagonal, F.lit(0)), F.greatest(-diagonal, F.lit(0))
        n = F.greatest(F.lit(0), F.least(F.size(item) - item_at, F.size(words) - at))
        return _best_stretch(F.zip_with(F.slice(words, at + 1, n), F.slice(item, item_at + 1, n), lambda a, b: a == b))

    def better(best: Column, d: Column) -> Column:
        hopeless = (d["hits"] + (SPAN - 1) <= best) | (best >= F.size(item))
        return F.when(hopeless, best).otherwise(F.greatest(best, stretch(d["diagonal"])))

    return F.aggregate(diagonals, F.lit(0), better)


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, row_key, item_id, score, item_tokens), perhaps repeated; row_key is a hash of the text."""
    items = saved(benchmark.select(F.col(item_col).alias("item_id"), tokens_of(text_of(item_text_col)).alias("item")).filter(F.size("item") > 0).distinct())
    texts = _keyed(docs, id_col, text_col)
    hits = _candidates(texts, items)
    size = hits.agg(F.sum(64 + 8 * F.size("diagonals") + 24 * F.size("item") + F.length(F.array_join("item", "")))).first()[0] or 0
    # a text is joined and cut to tokens once, with all its items
    mine = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key")).agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("items"))
    mine = F.broadcast(mine) if size <= BROADCAST_BYTES else mine.hint("shuffle_hash")
    placed = texts.join(mine, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")))
    judged = lambda words: F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), _score(words, x["item"], x["diagonals"]).alias("score"), F.size(x["item"]).alias("item_tokens")))
    scored = placed.select("doc_id", "row_key", F.inline(bind(tokens_of(F.col("text")), judged)))
    return scored.filter(F.col("score") >= F.least(F.lit(MIN_SCORE), F.col("item_tokens")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, item_tokens) of each document and benchmark item that overlap.

    They overlap if their best stretch scores MIN_SCORE or more; an item of fewer tokens must occur whole. Null, empty
    and token-free texts and items overlap with nothing, and so does every text with an empty benchmark. Rows that repeat
    an id count as one, with its highest score; a null id is an id. Other columns are ignored, whatever their names.
    """
    kept = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return kept.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("item_tokens").alias("item_tokens"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows that overlap with a benchmark item; all columns stay, whatever their names.

    Each row is judged by its own text: of rows that share an id, or have none, only those that overlap go. Null and
    empty texts stay. An empty table stays empty.
    """
    bad = saved(_overlaps(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_key"))
    few = bad.count() * 64 <= BROADCAST_BYTES
    return rows.join(F.broadcast(bad) if few else bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("row_key") == F.col("bad_key")), "left_anti").select("row.*")


_MASK_KEYS = " UNION ALL ".join(
    f"SELECT rid, i - 1 AS p, '{k}:' || concat_ws(' ', {', '.join(f'w[i+{b}], w[i+{b + 1}]' for b in mask)}) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 10)) AS i FROM {{0}} WHERE len(w) >= 12)"
    for k, mask in enumerate(MASKS)
)
_SHORT_KEYS = "SELECT rid, i - 1 AS p, 's' || n || ':' || array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {0}, short WHERE len(w) >= n)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS rid, item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM benchmark),
short AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 11),
dk AS ({(_MASK_KEYS + " UNION ALL " + _SHORT_KEYS).replace("{0}", "d")}),
bk AS ({(_MASK_KEYS + " UNION ALL " + _SHORT_KEYS).replace("{0}", "b")}),
h AS (SELECT DISTINCT dk.rid AS dr, bk.rid AS br, dk.p - bk.p AS g FROM dk JOIN bk ON dk.k = bk.k),
j AS (SELECT h.dr, h.br, g, d.doc_id, b.item_id, d.w AS dw, b.w AS bw, unnest(range(greatest(1, 1 - g), least(len(b.w), len(d.w) - g) + 1)) AS i FROM h JOIN d ON h.dr = d.rid JOIN b ON h.br = b.rid),
s AS (SELECT dr, br, g, doc_id, item_id, len(bw) AS item_tokens, i, sum(CASE WHEN dw[i + g] = bw[i] THEN 1 ELSE {MISMATCH} END) OVER (PARTITION BY dr, br, g ORDER BY i) AS c FROM j),
m AS (SELECT *, c - least(0, coalesce(min(c) OVER (PARTITION BY dr, br, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS r FROM s)
SELECT doc_id, item_id, CAST(max(r) AS INTEGER) AS score, CAST(max(item_tokens) AS INTEGER) AS item_tokens FROM m GROUP BY doc_id, item_id, item_tokens
HAVING max(r) >= least({MIN_SCORE}, item_tokens)
"""
