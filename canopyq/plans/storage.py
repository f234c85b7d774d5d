"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session, as in tests, gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='canopyq-')}"
        spark.conf.set(_SETTING, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder, which runs it now, and reads it again: lineage ends here, and a lost executor costs nothing before it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def again(table: DataFrame) -> DataFrame:
    """A stored table as a table of its own, with columns that a join can tell from the first's."""
    out = table.sparkSession.read.schema(table.schema).parquet(table._stored_at)
    out._stored_at = table._stored_at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more; tables that aren't stored stay as they are."""
    for table in tables:
        at = vars(table).get("_stored_at")
        if at is not None:
            delete(table.sparkSession, at)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder wherever Spark can reach it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
