"""The archive's loop as Structured Streaming: ingest, sessions, late rows.

A file source with a checkpoint takes every file once; ``foreachBatch`` writes
each batch below its own number, so a batch that is repeated after a failure
replaces what it wrote before.  Sessions close when the watermark passes their
end; rows later than that are dropped by the stream and brought in by
``catch_up``, a batch join on what was processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import _filesystem


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """A stream of the files that appear at ``path``; JSON that doesn't fit the schema keeps its text in ``_corrupt``."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        r = r.schema(StructType([*schema.fields, StructField("_corrupt", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    fs, at = _filesystem(spark, path)
    if fs.exists(at) and fs.isFile(at):  # a file source reads folders: this one's, by name
        return r.option("pathGlobFilter", at.getName()).load(path.rpartition("/")[0])
    return r.load(path)


def sessions(events: DataFrame, keys: list[str], time_col: str, gap_seconds: int, late: str) -> DataFrame:
    """Closed sessions of a stream: keys, start, last, n.

    ``session_window`` parts events at exactly the gap, so it is given one
    microsecond more: exactly the gap stays together, as in the batch operator.
    """
    e = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    g = e.groupBy(*keys, F.session_window("__t", f"{gap_seconds} seconds 1 microsecond").alias("w"))
    return g.agg(F.min("__t").alias("start"), F.max("__t").alias("last"), F.count("*").alias("n")).drop("w")


def write_batches(stream: DataFrame, path: str, checkpoint: str, dead_letters: str | None = None, every: str | None = None):
    """Start writing a stream to ``path``/batch=N; returns the query.

    ``every`` is a processing-time trigger ("600 seconds"); without it all
    available files are worked off and the query ends.  Rows with a
    ``_corrupt`` text go to ``dead_letters`` and don't stop the stream.
    """

    def put(batch: DataFrame, number: int) -> None:
        good = batch
        if "_corrupt" in batch.columns:
            batch = batch.persist()
            if dead_letters:
                batch.where("_corrupt IS NOT NULL").select("_corrupt").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
            good = batch.where("_corrupt IS NULL").drop("_corrupt")
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_rows(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to Parquet files exactly once; all available input, then it ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(all_rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows that the stream hasn't processed (too late, or dropped): an anti join, safe for null keys."""
    p = processed.select(F.col(key).alias("__k")).distinct()
    return all_rows.join(p, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
