"""Streaming queries over the test tables, run until all that is there has been read."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalog import query
from corpusloom.plans.corpus import ROWS
from corpusloom.runtime import table
from corpusloom.streaming import ingest as I


def stream(spark: SparkSession, sf: str) -> DataFrame:
    path = Path(sf, "records.parquet")
    return I.records_stream(spark, str(path) if path.is_dir() else f"{sf}/records.parquet*", table(spark, sf, "records"))


@query("stream_distinct_keys", f"with {ROWS.strip()} select distinct key from q where ok")
def stream_distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return I.drain(I.first_of_key(I.accepted(stream(spark, sf))).select("key"), "distinct").select("key")


@query("stream_window_counts", "select date_trunc('day', arrived_at)::timestamp as start, bucket, count(*) as records, sum(length(text))::bigint as characters from records group by 1, 2")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day; each batch writes the groups it changed, of which the last counts."""
    rows = I.drain(I.window_counts(stream(spark, sf), "arrived_at", late="3650 days"), "windows", "update")
    last = rows.groupBy("start", "bucket").agg(F.max(F.struct("batch_", "records", "characters")).alias("x"))
    return last.select("start", "bucket", "x.records", "x.characters")
