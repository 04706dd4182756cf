"""The plug point for user-supplied readers of pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.session import ship
from docsheaf.settings import DEFAULTS, Settings

LEDGER = "content_key string, attempt int, text string, finish string, error string"
ATTEMPTS = "array<struct<attempt:int,text:string,finish:string,error:string>>"


def _attempts(content: object, reader: Callable[[object, int], dict], most: int) -> Iterator[tuple]:
    """(attempt, text, finish, error) until an attempt is decisive."""
    for attempt in range(1, most + 1):
        try:
            said, error = reader(content, attempt), None
        except Exception as problem:  # noqa: BLE001 - a page's failure is a result row, it must not end the job
            said, error = {}, str(problem)[:500]
        yield attempt, said.get("text"), said.get("finish", ""), error
        if error is None and (said.get("text") or said.get("finish") == "length"):
            return


def read_pages(pages: DataFrame, key: str, content: str, reader: Callable[[object, int], dict], partitions: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per page: key, attempts (attempt, text, finish, error, in order). reader(content, attempt) returns text and finish.

    Pages whose attempt fails or returns nothing are tried again, up to ocr_retries times. `partitions` bounds how many
    readers run at once.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tried = [[dict(zip(("attempt", "text", "finish", "error"), row, strict=True)) for row in _attempts(c, reader, settings.ocr_retries)] for c in frame[content]]
            yield pd.DataFrame({key: frame[key], "attempts": pd.Series(tried, frame.index, object)})

    source = pages.select(key, content)
    return (source.repartition(partitions) if partitions else source).mapInPandas(run, f"{key} {kind}, attempts {ATTEMPTS}")


def batch_read(pages: DataFrame, key: str, content: str, reader: Callable[[object, int], dict], partitions: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of read_pages(), one per attempt: key, attempt, text, finish, error."""
    return read_pages(pages, key, content, reader, partitions, settings).select(key, F.inline("attempts"))


class Ledger:
    """What one task has read: a folder of small files, one for each `flush` pages, that a later attempt of the task takes
    over. A file is there as a whole or not at all."""

    _schema = pa.schema([("content_key", pa.string()), ("attempt", pa.int32()), ("text", pa.string()), ("finish", pa.string()), ("error", pa.string())])

    def __init__(self, path: str, flush: int):
        self.system, self.folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        self.flush, self.rows, self.pages = flush, [], 0
        self.system.create_dir(self.folder, recursive=True)
        self.known: dict[str, list[tuple]] = {}
        for info in self.system.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".parquet"):
                for key, *row in zip(*pq.read_table(info.path, filesystem=self.system, schema=self._schema).to_pydict().values(), strict=True):
                    self.known.setdefault(key, []).append(tuple(row))

    def add(self, key: str, rows: list[tuple]) -> None:
        self.rows += [(key, *row) for row in rows]
        self.pages += 1
        if self.pages >= self.flush:
            self.close()

    def close(self) -> None:
        if self.rows:
            name = f"{self.folder}/{uuid.uuid4().hex}"
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self._schema, strict=True)]
            pq.write_table(pa.Table.from_arrays(columns, schema=self._schema), f"{name}.part", filesystem=self.system)
            self.system.move(f"{name}.part", f"{name}.parquet")
        self.rows, self.pages = [], 0


def ledger_read(pages: DataFrame, key: str, content: str, reader: Callable[[object, int], dict], ledger: str, variant: str = "", partitions: int | None = None, flush: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of batch_read(), with every attempt kept in a table at `ledger` as soon as its page is read.

    Pages are known by a hash of variant and content, so equal ones are read once. A task that is lost is run again on the
    same pages and takes over what the ledger has of them: a page that was finished is never sent to the reader again,
    nor is it when the result is computed a second time. Later runs take over pages that were read with success; failures
    are tried anew. `flush` pages share a file: with more than one, a lost task may repeat the pages of one file.
    """
    spark = ship(pages.sparkSession)
    kind = pages.schema[content].dataType.simpleString()
    named = pages.select(key, F.col(content).alias("content"), F.sha2(F.concat(F.encode(F.lit(variant + "\x00"), "utf-8"), F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))), 256).alias("content_key"))
    run, most = f"{ledger.rstrip('/')}/run={uuid.uuid4().hex}", settings.ocr_retries
    # A folder without files, so that the table can be read before the first run is over.
    Ledger(run, flush)
    known = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(ledger)
    good = known.filter("error is null and (coalesce(text, '') <> '' or finish = 'length')").select("content_key").distinct()
    before = known.join(good, "content_key", "left_semi").dropDuplicates(["content_key", "attempt"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Ledger(f"{run}/part={TaskContext.get().partitionId()}", flush)
        for frame in frames:
            rows = []
            for k, c in zip(frame["content_key"], frame["content"], strict=True):
                found = book.known.get(k)
                if found is None:
                    found = list(_attempts(c, reader, most))
                    book.add(k, found)
                rows += [(k, *row) for row in found]
            yield pd.DataFrame(rows, columns=["content_key", "attempt", "text", "finish", "error"])
        book.close()

    todo = named.dropDuplicates(["content_key"]).join(before.select("content_key").distinct(), "content_key", "left_anti").select("content_key", F.col("content").cast(kind).alias("content"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = todo.repartition(n, "content_key").mapInPandas(read, LEDGER)
    return named.select(key, "content_key").join(before.unionByName(new), "content_key").select(key, "attempt", "text", "finish", "error")
