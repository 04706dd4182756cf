"""Near-duplicate classes with order MinHash.

A text is the sequence of its 5-word shingles, each labelled with its occurrence number. For every hash function the
three labelled shingles with the least hashes are kept in their text order; their joint hash is one sketch. Unlike plain
MinHash, two texts share a sketch only if the sampled shingles agree in number and order, as under few edits. Texts that
share a sketch are candidates; a banded alignment of their shingles decides. Similarity is the length of the longest
common subsequence over the length of the union, at least 0.8 for a link; classes are the connected components.

Equal texts are one representative from the start. Candidates aren't expanded into all pairs: in each bucket all members
are compared with the first one, the links are joined to components, and only members outside the bucket's largest
component are then compared with the others, so no link between two components is lost.

Where a bucket has many such members (texts around one boilerplate passage, most of them not similar enough), its texts
are split once more, without loss: two texts of similarity s or more share one of the n - ceil(s n) + 1 rarest labelled
shingles of either, n being its number of shingles. Only texts that share such a rare shingle are then compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from docsheaf.llm.common import joined_groups, saved, with_groups
from docsheaf.llm.substrings import _BASES, _mix, rolling, word_hashes
from docsheaf.session import ship

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a sketch of three agrees with probability near 0.5, so 14 sketches miss a pair with about 6e-5.
SAMPLED = 3
SKETCHES = 14
#: Members that stream past one set of queries in a row, and queries in such a set.
BLOCK = 1024
QUERIES = 512
#: Where a bucket has more sets of queries than this, its texts are split by rare shingles: below, sending a text once to
#: each set costs less than writing down all its shingles.
SETS = 32
PART = 1 << 16
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters, digits and underscores."""
    return [w.encode() for w in _WORD.findall(text.lower())]


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the 5-word shingles in order; a shorter text is one shingle, one without words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return rolling(word_hashes(words), min(SHINGLE, len(words)), _BASES[0])


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of an equal shingle apart."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if first.all():
        return _mix(hashes)
    starts = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    number = np.empty(len(hashes), dtype=np.uint64)
    number[order] = (np.arange(len(hashes)) - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(hashes + number * _BASES[1])


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _BASES[1])


def sketches(hashes: np.ndarray) -> np.ndarray:
    """SKETCHES joint hashes of the SAMPLED least labelled shingles in text order."""
    marks = labelled(hashes)
    best_key = np.empty((SKETCHES, 0), dtype=np.uint64)
    best_at = np.empty((SKETCHES, 0), dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(marks), PART):
            part = marks[at : at + PART]
            keys = (part[None, :] ^ _SEEDS[:, None]) * _BASES[0]
            keys ^= keys >> np.uint64(32)
            keys *= _BASES[1]
            keys = np.concatenate([best_key, keys], axis=1)
            places = np.concatenate([best_at, np.broadcast_to(np.arange(at, at + len(part)), (SKETCHES, len(part)))], axis=1)
            if keys.shape[1] > SAMPLED:
                least = np.argpartition(keys, SAMPLED - 1, axis=1)[:, :SAMPLED]
                keys, places = np.take_along_axis(keys, least, axis=1), np.take_along_axis(places, least, axis=1)
            best_key, best_at = keys, places
        in_order = marks[np.sort(best_at, axis=1)]
        out = _SEEDS.copy()
        for k in range(in_order.shape[1]):
            out = _mix(out * _BASES[0] + in_order[:, k])
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence if it is at least `least`, else some number below it.

    Common ends are taken off. The rest is a bit-parallel alignment (one bit for a place of a, one step for a place of
    b) within the band of diagonals that a subsequence of that length can use: at most len(a) - least places of a and
    len(b) - least of b may be skipped.
    """
    n, m = len(a), len(b)
    low = min(n, m)
    if low < least:
        return -1
    differ = np.flatnonzero(a[:low] != b[:low])
    head = int(differ[0]) if len(differ) else low
    a, b = a[head:], b[head:]
    low = min(len(a), len(b))
    if low:
        differ = np.flatnonzero(a[::-1][:low] != b[::-1][:low])
        tail = int(differ[0]) if len(differ) else low
        a, b, head = a[: len(a) - tail], b[: len(b) - tail], head + tail
    if not len(a) or not len(b):
        return head
    skip_a, skip_b = n - least, m - least
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    total, size, off, width, row = 0, len(a), 0, 0, 0
    # Bits off .. off + width - 1 of the classic row vector; 0 marks a place where the subsequence grows.
    for j, x in enumerate(b.tolist()):
        new_off, new_end = max(0, j - skip_b), min(size, j + skip_a + 1)
        if new_end <= new_off:
            break
        if new_off > off:
            gone = new_off - off
            total += min(gone, width) - (row & ((1 << min(gone, width)) - 1)).bit_count()
            row >>= gone
            width, off = max(width - gone, 0), new_off
        if new_end > off + width:
            row |= ((1 << (new_end - off - width)) - 1) << width
            width = new_end - off
        match = (places.get(x, 0) >> off) & ((1 << width) - 1)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & ((1 << width) - 1)
    return head + total + width - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, sorted_a: np.ndarray, sorted_b: np.ndarray, limit: float = SIMILARITY) -> bool:
    """Whether the common subsequence is at least `limit` of the union. Shared shingles, whatever their order, bound it."""
    n, m = len(a), len(b)
    least = int(np.ceil(limit * (n + m) / (1 + limit) - 1e-9))
    if min(n, m) < least:
        return False
    both = np.sort(np.concatenate([sorted_a, sorted_b]), kind="stable")
    if int((both[1:] == both[:-1]).sum()) < least and len(both):
        return False
    return aligned(a, b, least) >= least


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, body, n, sketches): body is a digest of the words; null texts have none. docs: doc_id, row_key, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, n, found = [], [], []
            for text in map(pa.StringScalar.as_py, batch.column("text")):
                if text is None:
                    body.append(None)
                    n.append(0)
                    found.append([])
                    continue
                words = words_of(text)
                hashes = shingles(words)
                body.append(hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest())
                n.append(len(hashes))
                found.append(sketches(hashes).view(np.int64) if len(hashes) else [])
            columns = [pa.array(body, pa.string()), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *columns], names=["doc_id", "row_key", "body", "n", "sketches"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(read, "doc_id long, row_key long, body string, n int, sketches array<long>")


def shingle_table(texts: DataFrame) -> DataFrame:
    """(doc_id, shingles): the shingle hashes in order, 8 bytes each. texts: doc_id, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(words_of(text)).tobytes() for text in map(pa.StringScalar.as_py, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(read, "doc_id long, shingles binary")


def _verified(tasks: DataFrame, table: DataFrame) -> DataFrame:
    """tasks: (task, part, doc_id, role), role 0 a query, 1 a member, 2 a member that is also a query -> links (a, b), a < b.

    The shingles of a task arrive in order, queries first; members stream past them. A query and a member that this task
    has already joined through others aren't compared again, nor are two queries twice.
    """
    rows = tasks.join(table.withColumnRenamed("doc_id", "text_id").hint("shuffle_hash"), F.col("doc_id") == F.col("text_id")).select("task", "part", "role", "doc_id", "shingles")
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "task", "part").sortWithinPartitions("task", "part", "role", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, parent = None, [], {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                if (row["task"], row["part"]) != key:
                    key, held, parent = (row["task"], row["part"]), [], {}
                own = np.frombuffer(row["shingles"], np.uint64)
                mine = (row["doc_id"], own, np.sort(labelled(own)))
                if row["role"] == 0:
                    held.append(mine)
                    continue
                for other in held:
                    if other[0] == mine[0] or row["role"] == 2 and other[0] > mine[0] or root(other[0]) == root(mine[0]):
                        continue
                    if similar(other[1], mine[1], other[2], mine[2]):
                        a.append(min(other[0], mine[0]))
                        b.append(max(other[0], mine[0]))
                        parent[root(mine[0])] = root(other[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc_id, comp): the least id of each linked document's component, by rounds of least-neighbour joins with
    pointer jumping, each round a written table."""
    links = saved(links)
    edges = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        met = labels.join(near, F.col("doc_id") == F.col("a")).select("doc_id", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("doc_id").alias("comp"), F.col("comp").alias("next"))
        new = saved(met.join(jump, "comp", "left").select("doc_id", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        if new.filter("comp <> old").isEmpty():
            return new.select("doc_id", "comp")
        labels = new.select("doc_id", "comp")


def _outside(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (bucket, doc_id) as (task, doc_id), saved, with outside: whether a member is outside the bucket's largest
    component; with members and queries, the bucket's numbers of all and of those outside. Buckets of one component are
    left out."""
    own = saved(rows.withColumnRenamed("bucket", "task").join(comps, "doc_id", "left").select("task", "doc_id", F.coalesce("comp", "doc_id").alias("own")))
    counted = own.groupBy("task", "own").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("task").agg(F.max(F.struct("n", "own")).alias("top"), F.sum("n").alias("group_rows"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    placed = joined_groups(own, saved(top.select("task", "top", "group_rows")), ["task"], own.count())
    return saved(placed.select("task", "doc_id", (F.col("own") != F.col("top.own")).alias("outside"), F.col("group_rows").alias("members"), (F.col("group_rows") - F.col("top.n")).alias("queries")))


def _tasks(sized: DataFrame) -> DataFrame:
    """Tasks that compare the members outside the largest component with all members, in blocks of both."""
    q_parts, m_parts = F.ceil(F.col("queries") / QUERIES).cast("long"), F.ceil(F.col("members") / BLOCK).cast("long")
    spread = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    queries = sized.filter("outside").select("task", "doc_id", F.pmod(F.xxhash64("doc_id"), q_parts).alias("q"), spread(m_parts).alias("m"), F.lit(0).alias("role"))
    members = sized.select("task", "doc_id", spread(q_parts).alias("q"), F.pmod(F.xxhash64("doc_id"), m_parts).alias("m"), F.when(F.col("outside"), 2).otherwise(1).alias("role"))
    return queries.unionByName(members).select("task", F.xxhash64("q", "m").alias("part"), "doc_id", "role")


def rare_buckets(table: DataFrame) -> DataFrame:
    """(bucket, doc_id): each text under its rarest labelled shingles, enough of them that two texts of similarity
    SIMILARITY or more share one. Shingles of one text alone are left out. table: doc_id, shingles."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                marks = labelled(np.frombuffer(found.as_buffer(), np.uint64)).view(np.int64)
                for at in range(0, len(marks), PART):
                    part = marks[at : at + PART]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(part), pa.array(np.full(len(part), len(marks), dtype=np.int32))], names=["doc_id", "bucket", "n"])

    marks = saved(table.mapInArrow(spell, "doc_id long, bucket long, n int"))
    rarest = F.row_number().over(W.partitionBy("doc_id").orderBy("group_rows", "bucket"))
    needed = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    return with_groups(marks, ["bucket"], []).withColumn("place", rarest).filter((F.col("place") <= needed) & (F.col("group_rows") > 1)).select("bucket", "doc_id")


def _key(docs: DataFrame, id_col: str) -> Column:
    """Whole numbers as they are; a hash of other ids, null for null."""
    own = F.col(id_col)
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    return own.cast("long") if whole else F.when(own.isNotNull(), F.xxhash64(own))


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id), see classes(), and (doc_id, row_key, id_rows): the hash of the text that counts for an id, and
    the number of rows with that id."""
    ship(docs.sparkSession)
    named = docs.select(_key(docs, id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text")).filter("doc_id is not null")
    read = sketch_table(named).groupBy("doc_id").agg(F.min(F.struct("row_key", "body", "n", "sketches")).alias("x"), F.count(F.lit(1)).alias("id_rows"))
    table = saved(read.select("doc_id", "id_rows", "x.*"))
    nulls = table.filter("body is null").select("doc_id", F.col("doc_id").alias("rep"))
    represented = saved(with_groups(table.filter("body is not null").select("doc_id", "body"), ["body"], [F.min("doc_id").alias("rep")]).select("doc_id", "rep"))
    reps = table.filter("n > 0").join(represented.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    buckets = reps.select("doc_id", F.posexplode("sketches").alias("k", "sketch")).select("doc_id", F.xxhash64("k", "sketch").alias("bucket"))
    shared = saved(with_groups(saved(buckets), ["bucket"], [F.min("doc_id").alias("pivot")], where=F.col("group_rows") > 1).drop("group_rows"))
    wanted = table.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "row_key")
    texts = saved(shingle_table(named.join(wanted.hint("shuffle_hash"), ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id"])))

    pairs = saved(shared.filter("doc_id <> pivot").select("pivot", "doc_id").distinct())
    parts = F.ceil(F.col("group_rows") / BLOCK).cast("long")
    members = with_groups(pairs, ["pivot"], []).select(F.col("pivot").alias("task"), F.pmod(F.xxhash64("doc_id"), parts).alias("part"), "doc_id", F.lit(1).alias("role"))
    pivots = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("group_rows"))
    queries = pivots.select(F.col("pivot").alias("task"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("pivot").alias("doc_id"), F.lit(0).alias("role"))
    links = saved(_verified(members.unionByName(queries), texts))
    comps = components(links)

    # The first member has been compared with everyone in its bucket, so it takes no part.
    sized = _outside(shared.filter("doc_id <> pivot").select("bucket", "doc_id"), comps)
    many = F.col("queries") > SETS * QUERIES
    found = [saved(_verified(_tasks(sized.filter(~many)), texts))]
    split = saved(texts.join(sized.filter(many).select("doc_id").distinct(), "doc_id", "left_semi"))
    if not split.isEmpty():
        found.append(saved(_verified(_tasks(_outside(rare_buckets(split), comps)), texts)))
    for more in found:
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = None
    comps = comps or components(links)

    placed = represented.unionByName(nulls).join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("class_id"))
    return placed, table.select("doc_id", "row_key", "id_rows")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), one row for each id: class_id is the least id of the near-duplicate class.

    Texts with the same words are always in one class, so are texts without words; every null text is a class of its
    own. Of rows that repeat an id the one with the least text hash counts. Rows without an id are in no class and give
    no row; an empty table gives none. Other columns are ignored, whatever their names. Ids may be of any type; those that
    aren't whole numbers are handled by their 64-bit hashes and come back as they were.
    """
    placed = _classed(docs, id_col, text_col)[0]
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return placed
    names = saved(docs.filter(F.col(id_col).isNotNull()).select(_key(docs, id_col).alias("doc_id"), F.col(id_col).alias("name")).distinct())
    named = saved(placed.join(names, "doc_id"))
    least = with_groups(named.select("class_id", "name"), ["class_id"], [F.min("name").alias("least")])
    return least.select(F.col("name").alias("doc_id"), F.col("least").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, that of the least id, or of the least hash of ids that aren't whole
    numbers; all columns stay, whatever their names.

    Rows that repeat an id are one document: the row whose text was classed stays, of several such rows that with the
    least hash over all columns. Rows without an id are in no class and stay. An empty table stays empty.
    """
    classed, rows = _classed(docs, id_col, text_col)
    firsts = saved(classed.filter("doc_id = class_id").select("doc_id").join(rows, "doc_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(docs, id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"))
    kept = rows.join(firsts, ["doc_id", "row_key"])
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("row"), F.xxhash64(F.lit(1), "row")))
    repeated = kept.filter("id_rows > 1").withColumn("place", place).filter("place = 1")
    return kept.filter("id_rows = 1").select("row.*").unionByName(repeated.select("row.*")).unionByName(rows.filter("doc_id is null").select("row.*"))
