"""WARC archives through a chunked record table.

A payload travels as rows (record id, chunk number, bytes), never whole: the writer and the reader hold one chunk and
the running digest of one record. Records with equal payloads are written once; the others become revisit records that
name it. Archives are gzip files with one member per record, written to a shared folder through pyarrow's file systems;
only files named by tasks that succeeded are read back. Files of failed attempts stay in the folder until whoever owns
spark.checkpoint.dir clears it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import saved, with_groups, work_dir

CHUNK_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"
CHUNK_SCHEMA = "record_id string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, is_last boolean, record_type string, refers_to string, payload_bytes long, payload_digest string, uri string"


def base32_sha1(digest: hashlib._Hash) -> str:
    return base64.b32encode(digest.digest()).decode()


def base32_of_hex(hex_digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each five of these are four of base32."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payloads(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("string").alias("record_id"), data.alias("payload")).withColumn("digest", F.sha1("payload"))


def payload_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", text_col: str = "html", known: DataFrame | None = None) -> DataFrame:
    """Chunked record table of a text column: (record_id, digest, row_no, chunk_no, data); an empty payload has one empty chunk.

    row_no tells rows of equal id and payload apart. A payload is sliced within its row and only its slices go on, so no
    row carries both a payload and a chunk number. Records in `known` (record_id, digest; a table to broadcast) have none.
    """
    whole = _payloads(pages, id_col, text_col)
    if known is not None:
        gone = F.broadcast(known.select(F.col("record_id").alias("known_id"), F.col("digest").alias("known_digest")))
        whole = whole.join(gone, F.col("record_id").eqNullSafe(F.col("known_id")) & (F.col("digest") == F.col("known_digest")), "left_anti")
    last = F.floor((F.greatest(F.octet_length("payload"), F.lit(1)) - 1) / chunk_bytes).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("payload", k * chunk_bytes + 1, F.lit(chunk_bytes)))
    cut = whole.select("record_id", "digest", F.monotonically_increasing_id().alias("row_no"), slices.alias("slices"))
    return cut.select("record_id", "digest", "row_no", F.posexplode("slices").alias("chunk_no", "data"))


def decisions(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", text_col: str = "html", uri_col: str = "url") -> DataFrame:
    """(record_id, digest, payload_bytes, copies, first, alone, refers_to, uri): of equal payloads of at least least_bytes
    the largest id answers; smaller ones stand alone.

    `copies` rows share the id and the payload, and `uri` is the least of theirs; if `first`, one of them is the response.
    A null id answers only if all are null. The result is saved.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    heads = pages.select(F.col(id_col).alias("id"), F.sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("n"), F.col(uri_col).cast("string").alias("uri"))
    rows = saved(heads.groupBy("id", "digest", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("uri").alias("uri")))
    grouped = with_groups(rows, ["digest"], [F.max("id").alias("keeper")])
    alone = F.col("n") < least_bytes
    first = alone | F.col("id").eqNullSafe(F.col("keeper"))
    return saved(grouped.select(F.col("id").cast("string").alias("record_id"), "digest", F.col("n").alias("payload_bytes"), "copies", first.alias("first"), alone.alias("alone"), F.col("keeper").cast("string").alias("refers_to"), "uri"))


def _urn(record_id: str | None, number: int) -> str:
    """A record's name: its id, escaped, or none, and a number among the records of that id."""
    return f"<urn:record:none:{number}>" if record_id is None else f"<urn:record:id:{quote(record_id, safe='')}:{number}>"


def _header(kind: str, record_id: str | None, uri: str | None, payload: int, digest: str, block: int, number: int, refers_to: str | None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id, number)}", f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {(uri or '').translate({10: None, 13: None})}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _http(payload: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload}\r\n\r\n".encode()


class _Writer:
    """Writes one archive file, one gzip member per record, chunk by chunk."""

    def __init__(self, folder: str):
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out, self.records, self.member = files.open_output_stream(f"{path}/{self.name}", compression=None), 0, None

    def put(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def begin(self, header: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(header)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        self.out.write(self.member.flush())
        self.records += 1


def write_warc(chunks: DataFrame, decided: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below folder; returns (file, records), saved, for the files of tasks that succeeded.

    Chunks and decisions meet in one shuffle by record and are sorted, the decision first, then row by row, so a record
    streams by. Revisits need no chunk. A response's SHA-1 is carried along and must end at the announced digest. Where
    rows share id and payload, the first row's chunks make the response; those of the others make responses of their
    own if the payload stands alone, and are passed over if not.
    """
    blank = {"payload_bytes": "long", "copies": "long", "first": "boolean", "alone": "boolean", "refers_to": "string", "uri": "string"}
    heads = decided.select("record_id", "digest", F.lit(-1).cast("long").alias("row_no"), F.lit(-1).alias("chunk_no"), F.lit(b"").alias("data"), *blank)
    rows = chunks.select("record_id", "digest", "row_no", "chunk_no", "data", *[F.lit(None).cast(t).alias(k) for k, t in blank.items()]).unionByName(heads)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "record_id", "digest").sortWithinPartitions("record_id", "digest", "row_no", "chunk_no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, number, running, sent = None, None, 0, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["row_no"] == -1:
                    head, number, digest = row, 0, base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    out = out or _Writer(folder)
                    for k in range(row["copies"] if row["alone"] else int(row["first"]), row["copies"]):
                        out.begin(_header("revisit", row["record_id"], row["uri"], row["payload_bytes"], digest, 0, k, row["refers_to"]))
                        out.end()
                    continue
                assert head is not None and (head["record_id"], head["digest"]) == (row["record_id"], row["digest"])
                if not head["alone"] and (number or not head["first"]):
                    continue  # a revisit, or another row of the record that has been written
                if row["chunk_no"] == 0:
                    http = _http(head["payload_bytes"])
                    out.begin(_header("response", row["record_id"], head["uri"], head["payload_bytes"], digest, len(http) + head["payload_bytes"], number, None))
                    out.put(http)
                    running, sent = hashlib.sha1(), 0
                running.update(row["data"])
                sent += len(row["data"])
                out.put(row["data"])
                if sent == head["payload_bytes"]:
                    if base32_sha1(running) != digest:
                        raise ValueError(f"record {row['record_id']}: the chunks do not add up to {digest}")
                    out.end()
                    number += 1
        if out:
            out.out.close()
            yield pa.RecordBatch.from_pydict({"file": [out.name], "records": [out.records]})

    return saved(ordered.mapInArrow(write, "file string, records long"))


class _Stream:
    """Bytes of the gzip members of a file, in bounded pieces."""

    def __init__(self, raw, step: int = 1 << 16):
        self.raw, self.step, self.held, self.member = raw, step, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.member.unconsumed_tail or self.member.unused_data or self.raw.read(self.step)
        if not data:
            return False
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(data, self.step)
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.held:
            if not self._more():
                return None
        line, self.held = self.held.split(b"\r\n", 1)
        return line

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one."""
        while not self.held:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.take(n))
            n -= len(parts[-1])
        return b"".join(parts)


def _fields(stream: _Stream) -> dict[str, str] | None:
    first = stream.line()
    while first == b"":
        first = stream.line()
    if first is None:
        return None
    fields = {"": first.decode()}
    while line := stream.line():
        name, _, value = line.decode().partition(":")
        fields[name.lower()] = value.removeprefix(" ")
    return fields


def _id(urn: str | None) -> str | None:
    kind, _, rest = urn.removeprefix("<urn:record:").partition(":") if urn else ("none", "", "")
    return None if kind == "none" else unquote(rest.rpartition(":")[0])


def _records(stream: _Stream, chunk_bytes: int) -> Iterator[dict]:
    while (f := _fields(stream)) is not None:
        block, kind = int(f["content-length"]), f["warc-type"]
        if block:
            size = 0
            while line := stream.line():
                size += len(line) + 2
            block -= size + 2
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        head = {"record_id": _id(f["warc-record-id"]), "record_type": kind, "refers_to": _id(f.get("warc-refers-to")), "payload_bytes": int(f["warc-payload-length"]), "payload_digest": digest, "uri": f["warc-target-uri"]}
        running, sent, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.exactly(min(chunk_bytes, block - sent))
            running.update(data)
            sent += len(data)
            last = sent == block
            so_far = base32_sha1(running)
            if last and kind == "response" and so_far != digest:
                raise ValueError(f"record {head['record_id']}: digest {so_far}, announced {digest}")
            yield head | {"chunk_no": number, "data": data, "bytes_so_far": sent, "digest_so_far": so_far, "is_last": last}
            number += 1
            if last:
                break


def read_warc(files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives (file) below folder, one task for each; see CHUNK_SCHEMA.

    Every chunk carries the digest of the payload so far; a response whose last one isn't the announced digest fails.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, path = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with base.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    rows, held = [], 0
                    for row in _records(_Stream(raw), chunk_bytes):
                        rows.append(row)
                        held += len(row["data"])
                        if held > 64 * chunk_bytes or len(rows) >= 2000:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(read, CHUNK_SCHEMA)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = dict(x.split() for x in CHUNK_SCHEMA.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[kinds[n]]) for n in names], names=names)


#: Revisits are kept out of the chunked table by a broadcast of up to so many of their names (some 100 bytes each).
#: Beyond, their chunks travel too, and the writer passes them over.
BROADCAST_REVISITS = 500_000


def archive_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", text_col: str = "html", uri_col: str = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes a record for every row of pages, reads the archives back and returns one row per record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, uri. Null payloads count as empty. Repeated
    rows are one response and revisits of it; a row with a null id answers only where all equal payloads have none. Line
    feeds and carriage returns are left out of URIs, a null one is empty, and rows of equal id and payload get the least
    of theirs. An empty table writes nothing and gives no rows; other columns are ignored, whatever their names.
    """
    kind = pages.select(id_col).schema[0].dataType
    folder = work_dir(pages.sparkSession)
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    decided = decisions(pages, least_bytes, id_col, text_col, uri_col)
    revisits = decided.filter("not first").select("record_id", "digest")
    chunks = payload_chunks(pages, chunk_bytes, id_col, text_col, revisits if revisits.count() <= BROADCAST_REVISITS else None)
    files = write_warc(chunks, decided, folder)
    rows = read_warc(files, folder, chunk_bytes).filter("is_last")
    return rows.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).cast(kind).alias("refers_to"), "uri"
    )


#: Base32 of a hexadecimal SHA-1 in SQL, by five hexadecimal digits at a time.
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, url FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, coalesce(url, '') AS uri FROM m
"""
