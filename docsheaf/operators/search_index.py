"""A stored positional index of texts: searches read postings, and of the texts only those that can hold the string.

Postings are one row for each term of a run of texts: (bucket, batch, term, n, docs, ats), the last two arrays of n items,
document by document and place by place. They are dealt by the hash of the term into partitions of the table, large ones
over several files, and sorted within a file, so that Parquet's delta encoding packs documents and places. A refresh adds a
batch with the texts that are new or have changed; postings count only if their batch is the newest one of their document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.functions.containment import containing, words
from docsheaf.operators.evidence import asked_needles, found_spots
from docsheaf.session import ship, stored

BUCKETS = 16
#: Texts of a task are indexed in runs of about this many words; a longer text is a run by itself.
RUN_WORDS = 4_000_000


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _listed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doc, digest, batch, number) of every text that was ever written."""
    return spark.read.schema(f"doc {kind}, digest long, batch string, number int").parquet(f"{path}/docs")


def _newest(listed: DataFrame) -> DataFrame:
    return listed.groupBy("doc").agg(F.max(F.struct("number", "batch", "digest")).alias("x")).select("doc", "x.*")


def _grouped(run_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc, words) to rows of (term, n, docs, ats), one for each term of a run of texts."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, spelled = batch.columns
            ends, first = spelled.offsets.to_numpy(), 0
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + run_words, "right")) - 1)
                sizes = np.diff(ends[first : last + 1])
                terms = spelled.values.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
                codes = terms.indices.to_numpy()
                by_term = np.argsort(codes, kind="stable")
                n = np.bincount(codes, minlength=len(terms.dictionary))
                doc = np.repeat(np.arange(first, last), sizes)[by_term]
                at = (np.arange(len(codes)) - np.repeat(ends[first:last] - ends[first], sizes))[by_term]
                bounds = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (docs.take(pa.array(doc)), pa.array(at.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(n.astype(np.int64)), *lists], names=["term", "n", "docs", "ats"])
                first = last

    return group


def _write(docs: DataFrame, path: str, number: int, run_words: int) -> None:
    """Postings first: those of a job that failed belong to no listed batch and never count."""
    ship(docs.sparkSession)
    batch, kind = F.lit(uuid.uuid4().hex).alias("batch"), docs.schema["doc"].dataType.simpleString()
    terms = docs.select("doc", words(F.lower("text")).alias("words")).mapInArrow(_grouped(run_words), f"term string, n long, docs array<{kind}>, ats array<int>").filter("term <> ''")
    rows = terms.select(_bucket().alias("bucket"), batch, "term", "n", "docs", "ats").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    rows.write.mode("append").option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/terms")
    docs.select("doc", F.xxhash64("text").alias("digest"), batch, F.lit(number).alias("number")).write.mode("append").parquet(f"{path}/docs")


def write_index(docs: DataFrame, path: str, run_words: int = RUN_WORDS) -> None:
    """A new index below path. docs: doc (unique), text. Null texts hold nothing."""
    _write(docs.filter("text is not null").select("doc", "text"), path, 0, run_words)


def refresh_index(docs: DataFrame, path: str, run_words: int = RUN_WORDS) -> None:
    """Adds the texts of docs that the index doesn't have in this form. Those that docs has no more stay."""
    known = _newest(_listed(docs.sparkSession, path, docs.schema["doc"].dataType.simpleString()))
    number = (known.agg(F.max("number")).first()[0] or 0) + 1
    digest = F.xxhash64("text").alias("digest")
    new = docs.filter("text is not null").select("doc", "text", digest).join(known.select("doc", "digest"), ["doc", "digest"], "left_anti")
    _write(new.select("doc", "text"), path, number, run_words)


def _runs(spark: SparkSession, path: str, kind: str, terms: DataFrame) -> DataFrame:
    """The rows of the given terms (a column `term`), of any batch."""
    buckets = [r[0] for r in terms.select(_bucket()).distinct().collect()]  # BUCKETS rows at most
    rows = spark.read.schema(f"batch string, term string, n long, docs array<{kind}>, ats array<int>, bucket int").parquet(f"{path}/terms").filter(F.col("bucket").isin(buckets or [-1]))
    return rows.join(terms.select("term").distinct(), "term", "left_semi")


def _postings(runs: DataFrame) -> DataFrame:
    """(term, batch, doc, at)"""
    return runs.select("term", "batch", "ats", F.posexplode("docs").alias("i", "doc")).select("term", "batch", "doc", F.get("ats", F.col("i")).alias("at"))


def _current(postings: DataFrame, path: str, kind: str) -> DataFrame:
    return postings.join(_newest(_listed(postings.sparkSession, path, kind)).select("doc", "batch"), ["doc", "batch"], "left_semi")


def _in_a_row(asked: DataFrame, path: str, kind: str) -> DataFrame:
    """(string, doc): texts in which the inner words of a string follow each other. asked: string, term, k (its place).

    The postings of a string's rarest word are the candidates. Its second rarest is looked up at the place where it would
    have to stand, which leaves few candidates; then the other words are.
    """
    spark = asked.sparkSession
    number = F.count(F.lit(1)).over(W.partitionBy("string"))
    # Postings of batches that are out of date count too: they may change which word comes first, but no result.
    rare = _runs(spark, path, kind, asked).groupBy("term").agg(F.sum("n").alias("n"))
    met = asked.withColumn("words", number).join(rare, "term").withColumn("met", number)
    # A word that the index doesn't have is in no text, and neither is the string.
    rank = F.row_number().over(W.partitionBy("string").orderBy("n", "term", "k"))
    ranked = stored(met.filter("met = words").withColumn("rank", rank).select("string", "term", "k", "words", "rank"))

    def meeting(starts: DataFrame, some: DataFrame) -> DataFrame:
        """The rows of starts for each of some words that stands where it has to."""
        wanted = stored(starts.join(some.select("string", "term", "k"), "string").withColumn("at", F.col("start") + F.col("k")))
        # Most postings go by their document alone, which is cheaper to look up than the place of a word.
        near = _postings(_runs(spark, path, kind, some)).join(wanted.select("doc").distinct(), "doc", "left_semi")
        return wanted.join(near, ["term", "batch", "doc", "at"]).select(*starts.columns)

    first, second, others = ranked.filter("rank = 1"), ranked.filter("rank = 2"), ranked.filter("rank > 2")
    starts = _current(first.join(_postings(_runs(spark, path, kind, first)), "term"), path, kind).select("string", "words", "batch", "doc", (F.col("at") - F.col("k")).alias("start"))
    two = stored(meeting(starts.filter("words > 1"), second))
    all_of_it = meeting(two.filter("words > 2"), others).groupBy(*two.columns).agg(F.count(F.lit(1)).alias("n")).filter("n = words - 2")
    return starts.filter("words = 1").select("string", "doc").unionByName(two.filter("words = 2").select("string", "doc")).unionByName(all_of_it.select("string", "doc")).distinct()


def candidates(strings: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """(string, doc): the texts that may hold a string, by the index alone where the string has a letter or digit.

    Inner words have to follow each other; a string without any is looked up by its longest part among the terms. docs
    is read only for strings of nothing but marks and blanks. strings: string, lower case; docs: doc, text.
    """
    spark, kind = docs.sparkSession, docs.schema["doc"].dataType.simpleString()
    parts = strings.select("string").distinct().withColumn("own", words(F.col("string"))).withColumn("inner", F.slice("own", F.lit(2), F.greatest(F.size("own") - 2, F.lit(0))))
    longest = F.array_max(F.transform("own", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = parts.filter(F.size("inner") > 0).select("string", F.posexplode("inner").alias("k", "term"))
    found = _in_a_row(asked, path, kind)
    short = parts.filter(F.size("inner") == 0).select("string", longest.alias("part"))
    if not short.filter("part <> ''").isEmpty():
        terms = spark.read.schema("term string, bucket int").parquet(f"{path}/terms").select("term").distinct()
        held = containing(terms, ["term"], "term", short.filter("part <> ''"), "part").select("term", F.explode("held").alias("part"))
        named = short.join(held, "part").select("string", "term")
        found = found.unionByName(named.join(_current(_postings(_runs(spark, path, kind, named)), path, kind), "term").select("string", "doc").distinct())
    if not short.filter("part = ''").isEmpty():
        low = docs.select("doc", F.lower("text").alias("low")).filter("low is not null")
        found = found.unionByName(containing(low, ["doc"], "low", short.filter("part = ''"), "string").select(F.explode("held").alias("string"), "doc"))
    return found


def search_index(queries: DataFrame, docs: DataFrame, path: str, limit: int = 12) -> DataFrame:
    """The rows of search_documents(), by the index at path. docs: conversation_id, position, doc (unique), text, as the
    index has them."""
    asked = asked_needles(queries)
    # A table's size is known, so that few candidates are sent to the texts; else all texts would be shuffled to meet them.
    named = stored(candidates(asked.select(F.col("needle").alias("string")), docs, path).groupBy("doc").agg(F.collect_set("string").alias("maybe")))
    texts = docs.join(named, "doc").withColumn("low", F.lower("text")).withColumn("held", F.filter("maybe", lambda s: F.contains(F.col("low"), s)))
    return found_spots(texts.filter(F.size("held") > 0).drop("maybe"), asked, limit)
