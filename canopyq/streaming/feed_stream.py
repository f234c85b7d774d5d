"""The machine-file feed as a stream: each file once, late ones too, rollups and a ledger kept by epoch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.operators import feed
from canopyq.plans.storage import discard, shared_folder, stored


def session_activity(files: DataFrame, gap: str = "30 minutes", by: str = "machine", time: str = "file_time") -> DataFrame:
    """Files and volume of each machine's working sessions; ``files`` has a watermark."""
    return files.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("volume_cm3").alias("volume")).select(by, F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n_files", "volume")


class RollupSink:
    """Keeps a rollup table and a ledger of file names up to date, one version of each an epoch, in a folder that outlives the driver.

    An epoch's version is the last one before it merged with the epoch's files that no earlier epoch's ledger has, so a file counts once however late it comes and however often. A
    repeated epoch, or a restarted driver, starts from the version before it and writes the same content again.
    """

    def __init__(self, spark: SparkSession, by: list[str], folder: str | None = None) -> None:
        self.by = by
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"

    def _epochs(self, spark: SparkSession) -> list[int]:
        """Epochs whose version is complete; the rollup is written after the ledger."""
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rollup")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        names = [s.getPath() for s in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n.getName()) for n in names if system.exists(context._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [e for e in self._epochs(spark) if e < epoch]
        whole = F.struct(*batch.columns)
        fresh = batch.groupBy("file_name").agg(F.min_by(whole, F.struct("file_time", *self.by)).alias("file")).select("file.*")
        if before:
            known = spark.read.parquet(*(f"{self.folder}/ledger/{e}" for e in before))
            fresh = fresh.join(known, "file_name", "left_anti")
        fresh = stored(fresh, "fresh")
        fresh.select("file_name").write.mode("overwrite").parquet(f"{self.folder}/ledger/{epoch}")
        change = feed.rollup(fresh, self.by, "file_time", "volume_cm3", "machine")
        if before:
            change = feed.merged_rollup(spark.read.parquet(f"{self.folder}/rollup/{before[-1]}"), change, self.by)
        change.write.mode("overwrite").parquet(f"{self.folder}/rollup/{epoch}")
        discard(fresh)

    def table(self, spark: SparkSession, schema: str) -> DataFrame:
        """The present rollup; empty before the first epoch."""
        epochs = self._epochs(spark)
        return spark.read.parquet(f"{self.folder}/rollup/{epochs[-1]}") if epochs else spark.createDataFrame([], schema)


def rolled_up_stream(files: DataFrame, by: list[str], folder: str | None = None) -> DataFrame:
    """Runs a stream of files to its present end and returns the rollup of all it held; with the same ``folder`` a later run goes on from there.

    The ledger tells files apart, not a watermark: a late file counts whenever it arrives.
    """
    spark = files.sparkSession
    sink = RollupSink(spark, by, folder)
    query = files.withColumn("file_time", F.col("file_time").cast("timestamp")).writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.folder}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in by)
    return sink.table(spark, f"{kinds}, n_files long, volume long, first_at timestamp, last_at timestamp, machines array<string>")
