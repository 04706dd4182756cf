"""Alignment of two tokenizations of a text by lockstep merging.

Both tokenizers cut space + text into tokens; the places where a token of each ends are the cuts, and the two tokens that
end there are linked. The texts of a batch are merged all at once: one NumPy state vector holds for every lane the next
token of A and of B. Each step compares where these end, emits a link and a cut where the ends agree, and advances the
one that ends first, or both. Lanes that are finished are taken out of the vector. A text takes a lane for each LANE
chunks of it, since no token of either tokenizer crosses the end of a chunk; so a very long text takes no more steps than
the others. How often two ids are linked in all texts is counted by Spark and joined back to the texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import joined_groups, saved
from docsheaf.llm.pieces import BYTE, KEPT_BYTES, MODEL, SPACE, Pieces
from docsheaf.llm.tokens import _LETTERS, ChunkIds, Recent, Run, token_path
from docsheaf.session import ship

BYTE_TOKENIZER = "byte_bpe_50k.json"
#: Chunks of a text in one lane.
LANE = 256
#: Texts are merged in runs of about this many bytes, which bounds what a worker holds.
RUN_BYTES = 4_000_000
#: Pairs found in over a SHARES-th of all rows are fewer than SHARES, so they are broadcast.
SHARES = 1 << 16
_ID_BITS = 24


class PlainIds(ChunkIds):
    """Ids of chunks; the strings of special tokens are ordinary text."""

    _loaded: dict[str, PlainIds] = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = Recent(KEPT_BYTES)
        letters = {c: b for b, c in _LETTERS.items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        #: The bytes of each id.
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes[k] = bytes(letters[c] for c in entry) if letters.keys() >= set(entry) else entry.encode()


def piece_bytes(model: Pieces) -> list[bytes]:
    return [bytes([model.bytes[k]]) if model.kind[k] == BYTE else piece.replace(SPACE, " ").encode() for k, piece in enumerate(model.text)]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of tokens that end together, in order.

    a_ends and b_ends are byte offsets; lane k has the tokens from a_bounds[k] to a_bounds[k + 1] of A, likewise of B. A
    lane has tokens of both or of neither, whose last ones end together.
    """
    a, b, a_stop = a_bounds[:-1], b_bounds[:-1], a_bounds[1:]
    alive = a < a_stop
    a, b, a_stop = a[alive], b[alive], a_stop[alive]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        same = end_a == end_b
        found_a.append(a[same])
        found_b.append(b[same])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        alive = a < a_stop
        if not alive.all():
            a, b, a_stop = a[alive], b[alive], a_stop[alive]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a)
    return a[order], b[order]


def _gathered(codes: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks in a row, and how many each chunk has. found: ids by code."""
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    ids = np.frombuffer(b"".join([found[k] for k in codes.tolist()]), "<i4")
    return ids, size[codes]


class Aligned:
    """The tokens, links and cuts of the rows of a run."""

    def __init__(self, run: Run, first: PlainIds, second: Pieces, lengths: tuple[np.ndarray, np.ndarray]):
        """lengths: bytes of each id of both tokenizers. A row whose tokens don't spell its text keeps none of them."""
        kinds = [k.encode() for k in run.kinds]
        found = first.all_of(run.kinds), second.all_of(run.kinds)
        spelled = [
            b"".join([first.bytes[k] for k in np.frombuffer(x, "<i4").tolist()]) == kind and b"".join([second.spelled[k] for k in np.frombuffer(y, "<i4").tolist()]) == kind
            for kind, x, y in zip(kinds, *found, strict=True)
        ]
        wrong = run.per_row(~np.array(spelled, dtype=bool)[run.codes]) > 0
        chunks = np.diff(run.bounds)
        codes = run.codes[~np.repeat(wrong, chunks)]
        rows = np.where(wrong, 0, chunks)
        #: Row i has the chunks from bounds[i] to bounds[i + 1].
        bounds = np.concatenate([[0], np.cumsum(rows)])
        (self.a, a_size), (self.b, b_size) = _gathered(codes, found[0]), _gathered(codes, found[1])
        self.a_bounds = np.concatenate([[0], np.cumsum(a_size)])[bounds]
        self.b_bounds = np.concatenate([[0], np.cumsum(b_size)])[bounds]
        lanes = np.unique(np.concatenate([bounds, *(np.arange(s, e, LANE) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if e - s > LANE)]))
        a_lanes, b_lanes = np.concatenate([[0], np.cumsum(a_size)])[lanes], np.concatenate([[0], np.cumsum(b_size)])[lanes]
        self.link_a, self.link_b = lockstep(np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b]), a_lanes, b_lanes)
        self.link_bounds = np.searchsorted(self.link_a, self.a_bounds)
        self.rows = len(rows)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, pair, n): each row's different linked id pairs, A's id above B's, with their numbers of links."""
        row = np.repeat(np.arange(self.rows), np.diff(self.link_bounds))
        pair = self.a[self.link_a].astype(np.int64) << _ID_BITS | self.b[self.link_b]
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
        return np.searchsorted(row[new], np.arange(self.rows + 1)), pair[new], np.diff(np.concatenate([new, [len(row)]]))

    def groups(self, spelled: list[bytes]) -> list[bytes]:
        """Each row's groups as `a1,a2|b1;a3|b2,b3`. spelled: see spellings()."""
        most = len(spelled) // 4
        a_code, b_code = self.a.astype(np.int64), self.b.astype(np.int64) + 2 * most
        a_code[self.link_a] += most
        b_code[self.link_b] += most
        # Within the cut that ends a group, tokens of A come before those of B.
        a_group, b_group = np.searchsorted(self.link_a, np.arange(len(self.a))), np.searchsorted(self.link_b, np.arange(len(self.b)))
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        text = [spelled[k] for k in np.concatenate([a_code, b_code])[order].tolist()]
        bounds = (self.a_bounds + self.b_bounds).tolist()
        return [b"".join(text[s:e])[:-1] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def spellings(most: int) -> list[bytes]:
    """Decimal ids with what follows them: of A inside a group and at its end, of B inside and at its end."""
    return [b"%d%s" % (k, mark) for mark in (b",", b"|", b",", b";") for k in range(most)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // RUN_BYTES
        places = np.concatenate([[0], np.flatnonzero(size[1:] != size[:-1]) + 1, [batch.num_rows]]).tolist()
        for start, stop in zip(places[:-1], places[1:], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)


def _spaced(run: Run) -> Run:
    """The first chunk of each non-empty text with a space before it."""
    first = run.bounds[:-1]
    firsts, code = np.unique(run.codes[first], return_inverse=True)
    run.codes = run.codes.astype(np.int64)
    run.codes[first] = len(run.kinds) + code
    run.kinds = run.kinds + [" " + run.kinds[k] if run.kinds[k] else "" for k in firsts.tolist()]
    return run


def aligned(docs: DataFrame, tokenizer: str = BYTE_TOKENIZER, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<long>, ns array<long>, and with
    with_groups the groups themselves as text.

    pairs are the row's different linked ids, A's times 2^24 plus B's, and ns their numbers of links. Null and empty
    texts, and those that one of the tokenizers doesn't spell, have zeros and empty values.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = PlainIds.of(token_path(tokenizer)), Pieces.of(token_path(model))
        second.spelled = piece_bytes(second)
        lengths = np.array(list(map(len, first.bytes))), np.array(list(map(len, second.spelled)))
        spelled = spellings(max(map(len, lengths)))
        for batch in _slices(batches):
            run = Aligned(_spaced(Run(batch)), first, second, lengths)
            bounds, pair, n = run.pairs()
            groups = run.groups(spelled)
            links = np.diff(run.link_bounds)
            numbers = [pa.array(x, pa.int64()) for x in (np.diff(run.a_bounds), np.diff(run.b_bounds), links, links)]
            digest = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in groups], pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (pair, n)]
            columns, names = [batch.column("doc_id"), *numbers, digest, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "ns"]
            if with_groups:
                columns, names = [*columns, pa.array([x.decode() for x in groups], pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = f"doc_id {ids}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, ns array<long>"
    return source.mapInArrow(read, columns + ", groups string" * with_groups)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links, group_rows, best) of the rows of aligned(): a pair's number of links in all of them, that of rows
    that have it, and whether no other pair of its B id has more links."""
    spread = rows.select(F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.ns").alias("n"))
    counts = saved(spread.groupBy("pair").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("group_rows")))
    second = F.col("pair").bitwiseAND((1 << _ID_BITS) - 1)
    # One row for each id of B, which the vocabulary bounds.
    highest = counts.groupBy(second.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(highest), second == F.col("b")).select("pair", "links", "group_rows", (F.col("links") == F.col("most")).alias("best"))


def links_report(docs: DataFrame, tokenizer: str = BYTE_TOKENIZER, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is its number of links in all rows. n_best are the row's links whose count is the highest of their B
    id, ties included, count_sum the sum of counts over its links. Texts that have no tokens (see aligned()) have zeros
    and ''. Rows that repeat an id, and rows without one, are aligned and counted each on its own; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    rows = saved(aligned(docs, tokenizer, model, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()))
    counts = saved(pair_counts(rows))
    spread = rows.select("row_id", F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select("row_id", F.col("x.pairs").alias("pair"), F.col("x.ns").alias("n"))
    total = counts.agg(F.sum("group_rows")).first()[0] or 0
    met = joined_groups(spread, counts, ["pair"], total, SHARES)
    sums = met.groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    told = rows.drop("pairs", "ns").join(sums, "row_id", "left")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
