"""Removal of repeated 50-word passages through a sparse De Bruijn graph.

Word k-mers are the edges of a De Bruijn graph. Of all edges of a document those with a locally least hash are kept
(every window of 50 words holds at least one, the same one wherever that window occurs), and the first and last. Each
edge that occurs in several documents keeps its first source coordinate (document, position). Consecutive edges of a
document whose first coordinates advance in step lie on one nonbranching path; joined in a row they are compacted to one
span, which the coordinates prove equal to a span of an earlier document, because consecutive edges overlap or touch.
Only at branches - edges that some later document holds in a window outside its compacted spans - are whole 50-word
windows hashed and joined. Edges are compared by 64-bit hashes and windows by two of them, not word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.llm.common import saved, text_of, with_groups

WINDOW = 50
K = 26
#: Edges per minimum: a window holds WINDOW - K + 1 edges. K >= STEP, so consecutive kept edges overlap or touch.
STEP = WINDOW - K + 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
WORD_CACHE = 1_000_000
ROWS_OUT = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hash of every k consecutive words, in log(k) array steps: blocks of doubling length joined by powers of base."""
    with np.errstate(over="ignore"):
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out, done, block, size, power = np.zeros(n, dtype=np.uint64), 0, hashes, 1, base
        shift, rest = np.uint64(1), k
        while rest:
            if rest & 1:
                out = out + shift * block[done : done + n]
                shift = shift * power
                done += size
            rest >>= 1
            if rest:
                block = block[:-size] + power * block[size:]
                size, power = size * 2, power * power
        return _mix(out)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def kept_edges(edges: np.ndarray) -> np.ndarray:
    """Positions of the first and the last edge and of those least within some STEP consecutive ones."""
    n = len(edges)
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    if n >= STEP:
        low = _sliding_min(edges, STEP)
        none = np.zeros(STEP - 1, dtype=np.uint64)
        padded = np.concatenate([none, low, none])
        highest = ~_sliding_min(~padded, STEP)  # of the minima of the windows that an edge lies in
        keep |= highest == edges
    return np.flatnonzero(keep)


def split_words(text: str | None) -> list[bytes]:
    """Words of the contract: bytes.split() splits at just the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def edges_of(docs: DataFrame) -> DataFrame:
    """(edge, doc_id, row_key, at, n_edges) of the kept edges; documents of fewer than WINDOW words have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column("doc_id").to_numpy(), batch.column("row_key").to_numpy(), batch.column("text")
            parts, rows = [], 0
            for k in range(batch.num_rows):
                words = split_words(texts[k].as_py())
                if len(words) >= WINDOW:
                    edges = rolling(word_hashes(words), K, _BASES[0])
                    at = kept_edges(edges)
                    parts.append((edges[at].view(np.int64), np.full(len(at), ids[k]), np.full(len(at), keys[k]), at.astype(np.int32), np.full(len(at), len(edges), dtype=np.int32)))
                    rows += len(at)
                if parts and (rows > ROWS_OUT or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["edge", "doc_id", "row_key", "at", "n_edges"])
                    parts, rows = [], 0

    return docs.select("doc_id", "row_key", "text").mapInArrow(find, "edge long, doc_id long, row_key long, at int, n_edges int")


def compacted(repeated: DataFrame) -> DataFrame:
    """Spans (doc_id, row_key, start, stop) in words that the coordinates prove equal to a span of a smaller document."""
    path = ["doc_id", "row_key", "first_doc", "first_key", "shift"]
    own = W.partitionBy(*path).orderBy("at")
    steps = repeated.filter(F.col("first_doc") < F.col("doc_id")).withColumn("shift", F.col("at") - F.col("first_at"))
    joined = steps.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(own) > K), F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(own))
    spans = joined.groupBy(*path, "part").agg(F.min("at").alias("start"), (F.max("at") + K).alias("stop"))
    return spans.filter(F.col("stop") - F.col("start") >= WINDOW).select("doc_id", "row_key", "start", "stop").distinct()


def _starts_covered(spans: list[dict], last: int) -> np.ndarray:
    """For window starts 0..last: whether some span holds the whole window."""
    change = np.zeros(last + 2, dtype=np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[s["stop"] - WINDOW + 1] -= 1
    return np.cumsum(change)[:-1] > 0


def _branches(repeated: DataFrame, span_lists: DataFrame) -> DataFrame:
    """(edge): repeated edges that a document other than the first holds in a window that no compacted span covers."""
    later = repeated.filter(F.col("first_doc") < F.col("doc_id"))
    marks = later.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("at", "edge")).alias("marks"), F.max("n_edges").alias("n_edges"))
    both = marks.join(span_lists, ["doc_id", "row_key"], "left").select("marks", "n_edges", "spans")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[int] = set()
            for row in batch.to_pylist():
                last = row["n_edges"] - STEP  # the last window start
                seen = np.concatenate([[0], np.cumsum(~_starts_covered(row["spans"] or (), last))])
                at = np.array([m["at"] for m in row["marks"]])
                low, high = np.maximum(at - (WINDOW - K), 0), np.minimum(at, last) + 1
                out.update(row["marks"][k]["edge"] for k in np.flatnonzero(seen[high] > seen[low]))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], names=["edge"])

    return both.mapInArrow(judge, "edge long").distinct()


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _uncovered(at: list[int], spans: list[dict], n_words: int) -> np.ndarray:
    """Starts of windows that hold a branch edge and lie in no span."""
    last = n_words - WINDOW
    wanted = np.zeros(last + 2, dtype=np.int64)
    for a in at:
        wanted[max(a - (WINDOW - K), 0)] += 1
        wanted[min(a, last) + 1] -= 1
    return np.flatnonzero((np.cumsum(wanted)[:-1] > 0) & ~_starts_covered(spans, last))


def _windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row_key, at) of the windows at branches that no span covers."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], 0
            for k, row in enumerate(batch.to_pylist()):
                hashes = word_hashes(split_words(row["text"]))
                starts = _uncovered(row["branches"], row["spans"] or (), len(hashes))
                both = [rolling(hashes, WINDOW, b)[starts].view(np.int64) for b in _BASES]
                parts.append((*both, np.full(len(starts), row["doc_id"]), np.full(len(starts), row["row_key"]), starts.astype(np.int32)))
                rows += len(starts)
                if rows > ROWS_OUT or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["h1", "h2", "doc_id", "row_key", "at"])
                    parts, rows = [], 0

    wanted = texts.filter(F.size("branches") > 0).select("doc_id", "row_key", "text", "branches", "spans")
    return wanted.mapInArrow(emit, "h1 long, h2 long, doc_id long, row_key long, at int")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows: doc_id, text, gone array<struct<start, stop>> -> the result of one document each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words, at, kept = split_words(row["text"]), 0, []
                for start, stop in _merged([(g["start"], g["stop"]) for g in row["gone"] or ()]):
                    kept += words[at:start]
                    at = stop
                kept += words[at:]
                text = b" ".join(kept)
                out.append((row["doc_id"], len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(5)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "gone").mapInArrow(cut, _RESULT)


def without_repeats(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and with with_text the kept words.

    A word goes if a window of WINDOW words over it also starts in a document with a smaller id. Null and empty texts
    have no words. Of rows that repeat an id none is smaller than another; each loses what a smaller id holds. Rows
    without an id lose nothing and take nothing away. An empty table gives no rows; other columns are ignored.
    """
    row = ["doc_id", "row_key"]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_key"), text_of(text_col).alias("text"))
    nameless, texts = texts.filter("doc_id is null"), texts.filter("doc_id is not null")
    edges = saved(edges_of(texts))
    shared = with_groups(edges, ["edge"], [F.min(F.struct("doc_id", "row_key", "at")).alias("first"), F.max("doc_id").alias("last_doc")], where=F.col("first.doc_id") < F.col("last_doc"))
    repeated = saved(shared.select("edge", *row, "at", "n_edges", F.col("first.doc_id").alias("first_doc"), F.col("first.row_key").alias("first_key"), F.col("first.at").alias("first_at")))
    span_lists = saved(compacted(repeated).groupBy(*row).agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    branches = saved(_branches(repeated, span_lists))
    at_branches = repeated.select("edge", *row, "at").join(branches, "edge", "left_semi")
    branch_lists = at_branches.groupBy(*row).agg(F.collect_set("at").alias("branches"))
    concerned = saved(branch_lists.join(span_lists, row, "full"))
    marked = texts.join(concerned.withColumn("marked", F.lit(True)).hint("shuffle_hash"), row, "left").unionByName(nameless, allowMissingColumns=True)
    first = saved(_first_cut(marked.withColumn("done", F.col("marked").isNull()), with_text))
    later = first.filter("text is not null")
    windows = saved(_windows(later))
    owned = with_groups(windows, ["h1", "h2"], [F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")], where=F.col("owner") < F.col("other"))
    hit = owned.filter("owner < doc_id").select(*row, F.col("at").alias("start"), (F.col("at") + WINDOW).alias("stop")).distinct()
    order = W.partitionBy(*row).orderBy("start")
    islands = hit.withColumn("new", F.coalesce(F.col("start") > F.lag("stop").over(order), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    found = islands.groupBy(*row, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy(*row).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rest = later.join(found.hint("shuffle_hash"), row, "left")
    ended = _cut(rest.select("doc_id", "text", F.concat(F.coalesce("spans", none), F.coalesce("found", none)).alias("gone")), with_text)
    out = first.filter("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").unionByName(ended)
    return out if with_text else out.drop("kept")


def _first_cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """Finishes the documents that share nothing; passes on the others with their text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, texts = batch.column("done").to_pylist(), batch.column("text")
            n, sums, kept, left = [], [], [], []
            for k, is_done in enumerate(done):
                text = texts[k].as_py()
                words = split_words(text) if is_done else []
                whole = b" ".join(words)
                n.append(len(words))
                sums.append(hashlib.sha256(whole).hexdigest() if is_done else None)
                kept.append(whole.decode() if is_done and with_text else None)
                left.append(None if is_done else text)
            columns = [pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *map(batch.column, ("row_key", "branches", "spans"))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text", "row_key", "branches", "spans"])

    schema = _RESULT + ", text string, row_key long, branches array<int>, spans array<struct<start:int,stop:int>>"
    return rows.select("doc_id", "row_key", "text", "done", "branches", "spans").mapInArrow(cut, schema)
