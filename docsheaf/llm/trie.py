"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards by ranges of their ids. A shard numbers its conversations in order of id and keeps, for
every position and turn, a posting: the bitset of conversations that have this turn there. The trie of the shard is
walked depth first: a node is the bitset of its members; the posting of the next turn of the lowest member, intersected
with it, is a child, and what is left of the bitset holds the other children. Popcounts are member counts, the lowest bit
is the smallest id, and the members without a further turn are the node's end list.

A node that several shards have is the same prefix, known by a hash of its turns. Their counts are added up; the first
shard that has it owns it, and only there it counts as a child, as a leaf and for the saved tokens. So sums over subtrees
are sums of the shards' own, each over a tree that fits into a worker, and no group, however large, meets in one place:
a prefix that a third of all conversations share is one row for each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import saved
from docsheaf.session import ship

#: Every conversation's base is the one whose id is its own less the remainder by FAMILY; up to HEADS - 1 turns are its.
FAMILY = 20
HEADS = 4
#: A shard is closed at the next family once it has so many conversations or turns.
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 1 << 17
ROOT = bytes(16)
_NODES = "shard long, seq long, parent_seq long, path binary, depth long, conv_id long, n long, kids long, words long, ends_sha256 string, ends binary"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, h, turn, role, digest, words) of each turn: 16 bytes stand for role and text, which don't travel."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps (a, bc) and (ab, c) apart.
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\n", F.octet_length(role), role, text), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    return conversations.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), (F.crc32(conv.cast("string")) % HEADS).cast("int").alias("h"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


class Shard:
    """Conversations with ascending ids and their turns, as (digest, words)."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.size = 0

    def add(self, conv: int, turns: list[tuple[bytes, int]]) -> None:
        self.ids.append(conv)
        self.turns.append(turns)
        self.size += len(turns)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_CONVERSATIONS or self.size >= SHARD_TURNS

    def nodes(self) -> Iterator[tuple]:
        """Rows of _NODES without the shard, parents before children."""
        postings: dict[tuple[int, bytes], int] = {}
        ended: dict[int, int] = {}
        for k, turns in enumerate(self.turns):
            bit = 1 << k
            ended[len(turns)] = ended.get(len(turns), 0) | bit
            for at, (digest, _) in enumerate(turns):
                postings[at, digest] = postings.get((at, digest), 0) | bit
        seq, stack = 0, [(-1, ROOT, 0, (1 << len(self.ids)) - 1, 0)]
        while stack:
            parent, path, depth, members, words = stack.pop()
            ends = members & ended.get(depth, 0)
            rest, kids = members & ~ends, 0
            while rest:
                digest, own = self.turns[(rest & -rest).bit_length() - 1][depth]
                child = rest & postings[depth, digest]
                stack.append((seq, hashlib.blake2b(path + digest, digest_size=16).digest(), depth + 1, child, own))
                rest ^= child
                kids += 1
            text = ",".join(self._named(ends)).encode()
            lowest = self.ids[(members & -members).bit_length() - 1]
            yield seq, parent, path, depth, lowest, members.bit_count(), kids, words, hashlib.sha256(text).hexdigest(), text
            seq += 1

    def _named(self, bits: int) -> Iterator[str]:
        while bits:
            low = bits & -bits
            yield str(self.ids[low.bit_length() - 1])
            bits ^= low


def _rebuilt(family: int, rows: dict[int, tuple[int, list[tuple[bytes, int]]]]) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """The conversations of a family by ascending id: the base's first h turns, then their own after the first h."""
    base = rows[family][1] if family in rows else []
    for conv in sorted(rows):
        h, own = rows[conv]
        yield conv, base[:h] + own[h:]


def shard_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every shard's trie: see _NODES. shard is its smallest conversation id, so shards ascend with ids.

    Families are dealt by ranges and streamed in order; a worker holds one shard and one family. The turns of one
    conversation, 16 bytes and a count each, are held together.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turn_rows(conversations).repartitionByRange(n, "family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest").select("family", "conv_id", "h", "digest", "words")
    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("parent_seq", pa.int64()), ("path", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary())])

    def written(shard: Shard) -> Iterator[pa.RecordBatch]:
        held = []
        for row in shard.nodes():
            held.append((shard.ids[0], *row))
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, rows = Shard(), None, {}
        for batch in batches:
            for family, conv, h, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if family != now:
                    for member in _rebuilt(now, rows):
                        shard.add(*member)
                    if shard.full():
                        yield from written(shard)
                        shard = Shard()
                    now, rows = family, {}
                rows.setdefault(conv, (h, []))[1].append((digest, words))
        for member in _rebuilt(now, rows):
            shard.add(*member)
        if shard.ids:
            yield from written(shard)

    return ordered.mapInArrow(walk, _NODES)


def _subtrees(rows: DataFrame) -> DataFrame:
    """Per row of a shard's trie, given with what all shards together know of the node (all_conv_id, all_n, leaf, owner):
    its parent's smallest member, and over its subtree the owned leaves and the saved tokens of owned nodes; children are
    the owned ones."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "shard").sortWithinPartitions("shard", "seq")
    names = ["path", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "shared"]

    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        get = lambda c: whole.column(c).to_numpy()
        parent, mine = get("parent_seq"), get("owner").astype(np.int64)
        kids = np.bincount(parent[1:], weights=mine[1:], minlength=len(parent)).astype(np.int64)
        leaves, tokens = (get("leaf") * mine).tolist(), ((get("all_n") - 1) * get("words") * mine).tolist()
        for k, up in zip(range(len(parent) - 1, 0, -1), parent[:0:-1].tolist(), strict=True):
            leaves[up] += leaves[k]
            tokens[up] += tokens[k]
        lowest = get("all_conv_id")
        above = pa.array(lowest[np.maximum(parent, 0)], pa.int64(), mask=parent < 0)
        columns = [whole["path"], whole["depth"], whole["all_conv_id"], above, whole["all_n"], *(pa.array(x, pa.int64()) for x in (kids, leaves, tokens)), whole["ends_sha256"], whole["shared"]]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = [0, *(np.flatnonzero(batch.column("seq").to_numpy() == 0)).tolist(), batch.num_rows]
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if held and part.column("seq")[0].as_py() == 0:
                    yield summed(held)
                    held = []
                held.append(part)
        if held:
            yield summed(held)

    columns = ordered.select("seq", "parent_seq", "path", "depth", "words", "ends_sha256", "all_conv_id", "all_n", "leaf", "owner", "shared")
    return columns.mapInArrow(climb, "path binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared boolean")


def _joined_ends(rows: DataFrame) -> DataFrame:
    """(path, ends_sha256) of the end lists of several shards, (path, shard, ends), whose ids ascend with the shards. They
    are hashed as they stream past, so no list is ever whole in memory."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "path").sortWithinPartitions("path", "shard").select("path", "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            paths, found = [], []
            for path, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        paths.append(now)
                        found.append(running.hexdigest())
                    now, running = path, hashlib.sha256(ends)
                else:
                    running.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(found, pa.string())], names=["path", "all_ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["path", "all_ends"])

    return ordered.mapInArrow(digest, "path binary, all_ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, path.

    conversations: conv_id, turn, role, text. Turns are ordered by turn, null first, then by role and by a hash of role
    and text; null roles and texts are empty. Every conversation c begins with the first h turns of conversation
    c - c % 20, h being crc32(decimal c) % 4, and goes on with its own after its first h. path is a hash of the node's
    turns. Rows that repeat are turns of their own. Rows without a conv_id are left out; an empty table gives no nodes;
    other columns are ignored, whatever their names.
    """
    ship(conversations.sparkSession)
    nodes = saved(shard_nodes(conversations))
    merged = nodes.groupBy("path").agg(F.min("conv_id").alias("all_conv_id"), F.sum("n").alias("all_n"), F.max("kids").alias("most_kids"), F.min("shard").alias("first_shard"), F.count(F.lit(1)).alias("shards"))
    shared = saved(merged.filter("shards > 1"))
    met = nodes.drop("ends").join(shared, "path", "left")
    known = met.select(
        "shard", "seq", "parent_seq", "path", "depth", "words", "ends_sha256", F.coalesce("all_conv_id", "conv_id").alias("all_conv_id"), F.coalesce("all_n", "n").alias("all_n"),
        (F.coalesce("most_kids", "kids") == 0).alias("leaf"), F.coalesce(F.col("first_shard") == F.col("shard"), F.lit(True)).alias("owner"), F.col("shards").isNotNull().alias("shared"),
    )
    sums = saved(_subtrees(known))
    ends = _joined_ends(nodes.filter(F.octet_length("ends") > 0).join(shared.select("path"), "path", "left_semi").select("path", "shard", "ends"))
    no_ends = hashlib.sha256(b"").hexdigest()
    names = ["path", "depth", "conv_id", "parent_conv_id", "n_convs"]
    whole = sums.filter("shared").groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]).join(ends, "path", "left").withColumn("ends_sha256", F.coalesce("all_ends", F.lit(no_ends)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"]
    return sums.filter("not shared").select(*columns).unionByName(whole.select(*columns))


#: Bytes of a decimal number through the bits of CRC-32 (polynomial 0xEDB88320), then its complement.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLE = rf"""
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(octet_length(encode(coalesce(role, ''))), chr(10), coalesce(role, ''), chr(10), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, b.pos, b.role, b.text FROM convs c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos < c.h
  UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, md5(concat(length(role), ':', role, text)) AS digest,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (
  SELECT path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256
  FROM prefixes p JOIN last l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, left(path, 32 * greatest(depth - 1, 0)) AS up FROM prefixes GROUP BY path, depth),
kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
above AS (SELECT left(n.path, 32 * k.d) AS path, n.n_convs, n.words, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN kids c ON c.path = n.path, LATERAL (SELECT unnest(range(n.depth + 1)) AS d) k),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM above GROUP BY path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.path = n.up LEFT JOIN kids k ON k.path = n.path JOIN sums s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
"""
