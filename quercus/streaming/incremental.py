"""Incremental analysis as a stream: new source files are parsed once and appended to stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quercus.sources.files import _complete
from quercus.sources.stages import SCHEMAS, Stages


def watch(spark: SparkSession, folder: str, out: str, extension: str = "erl", tables: tuple[str, ...] = ("functions", "calls", "expr_seqs", "errors")) -> StreamingQuery:
    """Parses the files that appear in ``folder`` and appends their rows to ``out/<table>``, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so no row is there twice.
    """
    for t in tables:
        if t not in SCHEMAS:
            raise ValueError(f"no stage table {t}")
    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(folder)
    lines = source.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def batch(df: DataFrame, number: int) -> None:
        s = Stages(_complete(df), persist=True)
        for t in tables:
            getattr(s, t).write.mode("overwrite").parquet(f"{out}/{t}/batch={number}")
        s.parsed.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of the newest batch in which each file was seen."""
    rows = spark.read.parquet(f"{out}/{table}")
    newest = rows.groupBy("file_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["file_id", "batch"], "left_semi").drop("batch")
