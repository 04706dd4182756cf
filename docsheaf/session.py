"""What a session needs before Python runs on executors: the package itself."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each Spark application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_docsheaf_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docsheaf-code-")) / "docsheaf.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._docsheaf_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share. Where that is unset a local
    master gets a temporary folder, as in tests; a cluster gets an error. Whoever owns the folder clears it after the job."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docsheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docsheaf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
