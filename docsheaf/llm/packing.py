"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of 2048 tokens and then into one piece for each binary digit of the rest.
Every piece is a sequence of its own, so none crosses documents and none is padded. Pieces of equal length form a bucket;
write_buckets() lays them out by bucket, so that a trainer draws batches of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.tokens import ChunkIds, Run, runs, token_path

SEQUENCE_TOKENS = 2048
END_ID = 1


def binary_pieces(n: int, longest: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the longest as go, then falling powers of two."""
    out = [(k * longest, longest) for k in range(n // longest)]
    start, rest = n - n % longest, n % longest
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((start, length))
        start, rest = start + length, rest - length
    return out


def _encoded(run: Run, known: ChunkIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a run in a row, each row's followed by end_id, and where each row's end."""
    found = known.all_of(run.kinds)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    first = np.cumsum(size) - size
    own = size[run.codes]
    ends = np.cumsum(run.per_row(own))
    places = np.arange(own.sum()) + np.repeat(first[run.codes] - (np.cumsum(own) - own), own)
    ids = np.insert(np.frombuffer(b"".join(found), "<u4")[places], ends, np.uint32(end_id))
    return ids, ends + np.arange(1, len(ends) + 1)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", longest: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, and with with_ids its ids.

    `longest` is a power of two, and so is every length, 2 ** bucket. Null and empty texts have just the end id. Repeated
    rows and rows without an id are packed each on its own, an empty table gives no rows, other columns are ignored,
    whatever their names. Sequence ids are unique, also where document ids aren't, and the same whenever a lost task is
    run again; another split of the input numbers them anew. (doc_id, start) names a piece whatever the split.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds.of(token_path(tokenizer))
        for run in runs(batches):
            encoded, ends = _encoded(run, known, end_id)
            whole = memoryview(encoded.tobytes())
            row, start, length, crc, total, payload, begin = [], [], [], [], [], [], 0
            for k, end in enumerate(ends.tolist()):
                for at, size in binary_pieces(end - begin, longest):
                    part = whole[4 * (begin + at) : 4 * (begin + at + size)]
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    total.append(end - begin)
                    if with_ids:
                        payload.append(bytes(part))
                begin = end
            columns = [run.batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(payload, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = source.mapInArrow(cut, f"doc_id {ids}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    bucket = F.log2("length").cast("int")
    return made.withColumns({"bucket": bucket, "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes packed sequences as Parquet below path/bucket=N, one folder for each length.

    Every task writes its own files to the folders, so nothing is shuffled and no bucket, however large, meets in one
    task. A reader that asks for one bucket opens its folder alone.
    """
    packed.write.partitionBy("bucket").parquet(path)
