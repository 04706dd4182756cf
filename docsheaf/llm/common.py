"""What the training-data operators share: tables, a shared work folder, skew-proof group joins, array helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.session import ship

#: ASCII white space, which separates words; fixed by the result contracts.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local master gets a temporary one, as in tests; a
    cluster gets an error, since its machines don't share such a folder.

    Nothing here deletes these folders: a table may be read until the job's results are. Whoever owns
    spark.checkpoint.dir clears its docsheaf-* folders once the job is over, whether it ended well or not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docsheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docsheaf-{uuid.uuid4().hex}"


def saved(df: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and rereads it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], total: int, shares: int = 1000) -> DataFrame:
    """df joined with a saved table of one row per key, whose group_rows tells how many rows of df, of total, a key has.

    A group with over 1/shares of the rows is hot; there are fewer than `shares` of these whatever the input, so they are
    broadcast and their rows stay where they are. All other groups meet in a shuffled join. Keys must not be null.
    """
    keys = list(keys)
    hot, rest = groups.filter(F.col("group_rows") > total / shares), groups.filter(F.col("group_rows") <= total / shares)
    heavy = df.join(F.broadcast(hot), keys)
    light = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return heavy.unionByName(light)


def with_groups(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], where: Column | None = None, shares: int = 1000) -> DataFrame:
    """Adds to each row of df aggregates of its group; rows of groups that fail `where` are dropped. See joined_groups().

    df is read three times, so give it a saved table. Key columns must not be null.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *aggs)
    return joined_groups(df, saved(groups if where is None else groups.filter(where)), keys, df.count(), shares)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often the lambdas inside use() refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words in text order, unchanged: runs of characters that are not ASCII white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))
