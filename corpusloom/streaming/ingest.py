"""Incremental intake as structured streams: normal form, filter, first of each key, late-data windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import Scratch, make_folder


def records_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 8) -> DataFrame:
    """New files of a folder of Parquet records, so many in a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def accepted(stream: DataFrame) -> DataFrame:
    """Normal form, key, and only acceptable text."""
    out = stream.withColumn("text", T.normalize("text"))
    out = out.withColumn("key", T.key("text"))
    return out.where(T.acceptable("text", "key"))


def first_of_key(stream: DataFrame, at: str | None = None, within: str = "30 days") -> DataFrame:
    """The first row of each key to come. With a time column only keys inside the watermark are remembered, so that state
    stays bounded; a copy that comes later than that passes as new. Without, all keys are remembered for ever: exact, and for
    streams that end or whose keys are few; state grows with the keys."""
    if at is None:
        return stream.dropDuplicates(["key"])
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(["key"])


def window_counts(stream: DataFrame, at: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, bucket, records, characters) of each window of event time; rows later than the watermark are dropped."""
    rows = stream.withWatermark(at, late)
    out = rows.groupBy(F.window(at, window), "bucket").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))
    return out.select(F.col("window.start").alias("start"), "bucket", "records", "characters")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into the shared folder, and read the result; its offsets and state are there too.

    A batch is written to a folder of its own number, in place of what an interrupted attempt left there, so that a replayed
    batch is not there twice. In update mode the last row of each group counts, so the caller keeps the latest by batch.
    """
    scratch = Scratch(stream.sparkSession, name)
    path, state = f"{scratch.base}/rows", f"{scratch.base}/state"

    write = batch_writer(path)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    make_folder(stream.sparkSession, path)  # a stream without any file runs no batch
    return stream.sparkSession.read.schema(f"{_ddl(stream)}, batch_ int").parquet(path)


def batch_writer(path: str):
    """A function for foreachBatch: batch n becomes path/batch_=n, whatever was there before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_={number}")

    return write


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
