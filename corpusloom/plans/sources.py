"""Queries on sources and sinks: tables are written in each format to the shared folder and read back from it."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalog import query
from corpusloom.runtime import Scratch, remove, table
from corpusloom.sources import files as S

COLUMNS = "rid, text, bucket, source, group_id, attribution, split"


def base(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return Scratch(spark, name).base


def records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records").select(*COLUMNS.split(", "))


@query("src_jsonl", f"select {COLUMNS} from records")
def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{base(spark, 'jsonl')}/records"
    S.write_jsonl(records(spark, sf), path)
    return S.read_jsonl(spark, path)


@query("src_splits", "select coalesce(split, '') as split, bucket, count(*) as records, sum(length(text))::bigint as characters from records group by 1, 2")
def src_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that the sink by splits gives of what it wrote."""
    return S.write_splits(records(spark, sf), f"{base(spark, 'splits')}/records").withColumn("split", F.coalesce("split", F.lit("")))


CSV = "select id, en, bn, bl from business"


def write_csv(spark: SparkSession, sf: str) -> str:
    path = f"{base(spark, 'csv')}/business"
    table(spark, sf, "business").select("id", "en", "bn", "bl").write.option("header", True).option("escape", '"').csv(path)
    return path


@query("src_csv", CSV)
def src_csv(spark: SparkSession, sf: str) -> DataFrame:
    """With its header checked, which every file has."""
    return S.read_csv(spark, write_csv(spark, sf), ["id", "en", "bn", "bl"])


@query("src_csv_unchecked", "select id as a, en as b, bn as c, bl as d from business")
def src_csv_unchecked(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_csv(spark, write_csv(spark, sf), ["a", "b", "c", "d"], check=False)


@query("src_forms", "select id, b as bucket, t as text from (select id, unnest(['bangla', 'banglish', 'english']) as b, unnest([bn, bl, en]) as t from business) where t <> ''")
def src_forms(spark: SparkSession, sf: str) -> DataFrame:
    return S.forms(table(spark, sf, "business").select("id", "bn", "bl", "en"), {"bn": "bangla", "bl": "banglish", "en": "english"})


def archives(df: DataFrame, write) -> DataFrame:
    """(content): an archive of the rows of each task."""

    def run(batches):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            write(z, [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))])
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])

    return df.mapInArrow(run, "content binary")


@query("src_zip_tsv", "select id, en, bn || chr(9) || bl as rest from business where en is not null and bn is not null and bl is not null")
def src_zip_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three fields of which the last holds a tabulator."""
    rows = table(spark, sf, "business").where("en is not null and bn is not null and bl is not null").select("id", "en", "bn", "bl")
    made = archives(rows, lambda z, rs: z.writestr("lines.tsv", "".join("\t".join(r) + "\n" for r in rs)))
    return S.zip_tsv(made, "lines.tsv", ["id", "en", "rest"])


@query("src_zip_csv", "select split, id, bn as bangla, en from business")
def src_zip_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A file of each split in each archive; the folder names the split."""

    def write(z: zipfile.ZipFile, rows: list[tuple]) -> None:
        import csv

        for split in sorted({r[0] for r in rows}):
            text = io.StringIO()
            w = csv.writer(text)
            w.writerow(["id", "text_bn", "en"])
            w.writerows(r[1:] for r in rows if r[0] == split)
            z.writestr(f"data/{split}/rows.csv", "﻿" + text.getvalue())

    rows = table(spark, sf, "business").select("split", "id", "bn", "en")
    made = S.zip_csv(archives(rows, write), {"_bn": "bangla"})
    return made.select("split", F.col("forms")["id"].alias("id"), F.col("forms")["bangla"].alias("bangla"), F.col("forms")["en"].alias("en"))


def dataset(spark: SparkSession, sf: str) -> str:
    """A dataset of three single files in a folder of the shared one, as a manifest names them."""
    root = base(spark, "dataset")
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for name, t in (("documents", "heldout"), ("queries", "mixture"), ("qrels", "sources")):
        part = f"{root}-parts/{name}"
        table(spark, sf, t).coalesce(1).write.json(part)  # tables of fixed size
        files = fs(part).getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(fs(part)) if s.getPath().getName().startswith("part-")]
        files.mkdirs(fs(root))
        files.rename(found[0], fs(f"{root}/{name}.jsonl"))
    remove(spark, f"{root}-parts")
    return root


@query("src_manifest", "select * from (values ('documents.jsonl', 'size'), ('gone.jsonl', 'missing'), ('qrels.jsonl', 'hash')) as t(path, problem)")
def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with one right entry and three wrong ones."""
    root = dataset(spark, sf)
    have = {r.path: r for r in S.file_hashes(spark, root).collect()}
    entry = lambda p, **other: {"path": p, "bytes": have[p].bytes, "sha256": have[p].sha256} | other
    return S.verify_manifest(spark, root, [entry("queries.jsonl"), entry("documents.jsonl", bytes=1), entry("qrels.jsonl", sha256="0" * 64), {"path": "gone.jsonl", "bytes": 1, "sha256": "0"}])


@query("src_dataset", "select * from (values ('qrels.jsonl', 'not covered'), ('queries.jsonl', 'hash'), ('a/b.jsonl', 'not a name'), ('a/b.jsonl', 'missing')) as t(path, problem)")
def src_dataset(spark: SparkSession, sf: str) -> DataFrame:
    root = dataset(spark, sf)
    have = {r.path: r.sha256 for r in S.file_hashes(spark, root).collect()}
    return S.verify_dataset(spark, root, {"documents.jsonl": have["documents.jsonl"], "queries.jsonl": "0" * 64, "a/b.jsonl": "0"})


@query("src_archive", """with l as (select query_id, document_id, max(grade) as grade from judgments group by query_id, document_id)
  select query_id, document_id, text, grade from (select distinct query_id, document_id from judgments union select distinct query_id, document_id from disagreements) p left join queries on id = query_id left join l using (query_id, document_id)""")
def src_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Labels archived without texts, and restored to the packet of all pairs."""
    j, d = table(spark, sf, "judgments"), table(spark, sf, "disagreements")
    labels = j.groupBy("query_id", "document_id").agg(F.max("grade").alias("grade"))
    pairs = j.select("query_id", "document_id").unionByName(d.select("query_id", "document_id")).distinct()
    packet = pairs.join(table(spark, sf, "queries").select(F.col("id").alias("query_id"), "text"), "query_id", "left")
    return S.restore(packet, S.archive(labels)).select("query_id", "document_id", "text", "grade")


@query("src_report", "select count(*) as records, count(distinct bucket) as buckets from records")
def src_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report as one JSON document in the shared folder, read back."""
    path = f"{base(spark, 'report')}/report.json"
    made = table(spark, sf, "records").agg(F.count("*").alias("records"), F.countDistinct("bucket").alias("buckets")).first().asDict()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    out.write(bytearray(json.dumps(made, indent=2).encode()))
    out.close()
    return spark.read.schema("records bigint, buckets bigint").option("multiLine", True).json(path)
