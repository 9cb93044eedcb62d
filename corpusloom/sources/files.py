"""Sources and sinks: JSON lines, CSV and TSV with contracts, archives, manifests, split-partitioned corpora, reports."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "rid bigint, text string, bucket string, source string, group_id string, attribution string, split string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType = RECORD) -> DataFrame:
    """JSON lines under a schema; the first malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def read_csv(spark: SparkSession, path: str, header: list[str], check: bool = True, multiline: bool | None = None) -> DataFrame:
    """A CSV of string columns; with check its header must be exactly as given, otherwise only the number of columns counts.

    multiline: whether values hold line breaks, in which case each file is read by one task. Without it the lines are looked
    through: if none has an odd number of quotes, no value reaches over its end, and large files are split.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    schema = ", ".join(f"`{c}` string" for c in header)
    first = spark.read.option("header", False).option("multiLine", multiline).option("escape", '"').csv(path).limit(1).collect()
    names = [str(x).lstrip("\ufeff") for x in first[0]] if first else []
    if (names != header) if check else (len(names) != len(header)):
        raise ValueError(f"unexpected header {names}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multiline).option("escape", '"').option("mode", "FAILFAST").csv(path)


def forms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each filled form of a row: (other columns, bucket, text); columns maps a column to its bucket."""
    others = [c for c in df.columns if c not in columns]
    parts = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(c).alias("text")) for c, b in columns.items()]))
    return df.select(*others, parts.alias("x")).select(*others, "x.bucket", "x.text").where("text <> ''")


#: Lines that a task holds of an archive at a time.
LINES = 10_000


def _batched(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, LINES)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some), kinds)], [n for n, _ in kinds])


def zip_tsv(archives: DataFrame, member: str, columns: list[str]) -> DataFrame:
    """read_zip_tsv() of archives that are there as a column content."""
    n, kinds = len(columns), [(c, pa.string()) for c in columns]

    def lines(contents: Iterator[bytes]) -> Iterator[tuple]:
        for content in contents:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, line in enumerate(io.TextIOWrapper(z.open(member), "utf-8", newline="\n")):
                    parts = line.rstrip("\r\n").split("\t", n - 1)
                    if len(parts) != n:
                        raise ValueError(f"line {i + 1} has {len(parts)} fields")
                    yield tuple(parts)

    def run(batches):
        yield from _batched(lines(x.as_py() for b in batches for x in b.column(0)), kinds)

    return archives.select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def read_zip_tsv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Lines of one member of each archive, parted at the first tabs into exactly so many columns.

    A malformed line or a missing member fails the read. Lines stream out of an archive, which a task reads whole (Spark's
    limit for binary files is 2 GB); many archives are read in parallel.
    """
    return zip_tsv(spark.read.format("binaryFile").load(path), member, columns)


def zip_csv(archives: DataFrame, suffixes: dict[str, str], rows: int | None = None) -> DataFrame:
    """read_zip_csv() of archives that are there as a column content."""
    kinds = [("file", pa.string()), ("split", pa.string()), ("forms", pa.map_(pa.string(), pa.string()))]

    def members(contents: Iterator[bytes]) -> Iterator[tuple]:
        for content in contents:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                    reader = csv.reader(io.TextIOWrapper(z.open(name), "utf-8-sig", newline=""))
                    header = next(reader, [])
                    named = [next((to for end, to in suffixes.items() if c.endswith(end) and c != end.lstrip("_")), c) for c in header]
                    for row in reader:
                        if len(row) != len(header):
                            raise ValueError(f"{name} has a row of {len(row)} columns")
                        yield name, PurePosixPath(name).parent.name, list(zip(named, row))

    def run(batches):
        yield from _batched(members(x.as_py() for b in batches for x in b.column(0)), kinds)

    made = archives.select("content").mapInArrow(run, "file string, split string, forms map<string, string>")
    if rows is not None and (found := made.count()) != rows:
        raise ValueError(f"{found} rows, not {rows}")
    return made


def read_zip_csv(spark: SparkSession, path: str, suffixes: dict[str, str], rows: int | None = None) -> DataFrame:
    """(file, split, forms) of all CSV members of archives, in the order of their names.

    split: the folder of the member. forms: a map of the columns, of which those that end in a suffix are named by it. A byte
    order mark is skipped; a member of another number of columns than the first row's fails the read, as does another total
    than `rows`.
    """
    return zip_csv(spark.read.format("binaryFile").load(path), suffixes, rows)


def is_local(path: str) -> bool:
    """Whether a path stays inside the folder it is taken from: not empty, not absolute, and never above its start."""
    if not path or path.startswith("/") or "\0" in path:
        return False
    depth = 0
    for part in path.split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
        if depth < 0:
            return False
    return True


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path inside root, bytes, sha256) of all files of a folder, at most 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.element_at(F.split("path", re.escape(root.rstrip("/").removeprefix("file:").replace("///", "/", 1)) + "/"), -1)
    return files.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, root: str, manifest: list[dict]) -> DataFrame:
    """(path, problem): files of a manifest (path, bytes, sha256) that are missing or differ; empty if all is well.

    Paths must stay inside the root.
    """
    for m in manifest:
        if not is_local(m["path"]):
            raise ValueError(f"path {m['path']!r} leaves the root")
    want = spark.createDataFrame([(m["path"], int(m["bytes"]), m["sha256"]) for m in manifest], "path string, want_bytes bigint, want_sha256 string")
    both = want.join(file_hashes(spark, root), "path", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.lower("want_sha256"), "hash")
    return both.select("path", problem.alias("problem")).where("problem is not null")


#: What a dataset's manifest must cover at least.
DATASET = ("documents.jsonl", "queries.jsonl", "qrels.jsonl")


def verify_dataset(spark: SparkSession, root: str, files: dict[str, str]) -> DataFrame:
    """(path, problem) of a dataset's manifest, file name to sha256: not covered: one of DATASET without a hash; not a name: a
    path in place of a file name; missing; hash. Empty if all is well."""
    early = [(f, "not covered") for f in DATASET if f not in files] + [(f, "not a name") for f in files if PurePosixPath(f).name != f or not f]
    want = spark.createDataFrame([(f, h) for f, h in files.items()], "path string, want string")
    both = want.join(file_hashes(spark, root), "path", "left")
    late = both.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.lower("want"), "hash").alias("problem")).where("problem is not null")
    return spark.createDataFrame(early, "path string, problem string").unionByName(late)


def batches(df: DataFrame, split: str, size: int = 256) -> Iterator[list[Row]]:
    """Lists of `size` rows, the last one shorter, in the order of df; raises at a row of another split.

    Rows come to the driver partition by partition, as a training loop wants them, never all at once.
    """
    rows = df.toLocalIterator(prefetchPartitions=True)
    while some := list(islice(rows, size)):
        for r in some:
            if r.split != split:
                raise ValueError(f"a row of split {r.split!r} among those of {split!r}")
        yield some


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines by split, and return counts and characters by split and bucket of what was written."""
    df.write.mode("errorifexists").partitionBy("split").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    return back.groupBy("split", "bucket").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))


def write_report(report: dict, path: str) -> None:
    """Indented JSON on the driver; refuses to overwrite."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)


#: What an archive of annotations may hold: no texts.
ARCHIVED = ("query_id", "document_id", "grade", "rationale", "reviewer_id", "reviewer_origin")


#: What an archive of decisions on pairs may hold: no texts.
DECIDED = ("query_id", "pair_correct", "privacy_review_passed", "exclusion_reason", "reviewer", "reviewer_origin")


def archive(reviews: DataFrame) -> DataFrame:
    """Reviews without any text; raises for a pair that is there twice."""
    out = reviews.select(*[c for c in ARCHIVED if c in reviews.columns])
    if not out.groupBy("query_id", "document_id").count().where("count > 1").isEmpty():
        raise ValueError("a pair is archived twice")
    return out


def archive_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions on pairs without any text; raises for a query that is there twice."""
    out = decisions.select(*[c for c in DECIDED if c in decisions.columns])
    if not out.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("a decision is archived twice")
    return out


def restore_decisions(packet: DataFrame, archived: DataFrame) -> DataFrame:
    """The frozen packet of queries (query_id, ...) with its archived decisions; raises for decisions on no query of it."""
    if not archived.join(packet, "query_id", "left_anti").isEmpty():
        raise ValueError("a decision is on no query of the packet")
    labels = [c for c in archived.columns if c != "query_id"]
    return packet.drop(*labels).join(archived, "query_id", "left")


def restore(packet: DataFrame, archived: DataFrame) -> DataFrame:
    """The frozen packet of pairs with its archived labels; pairs without one keep nulls. Raises for labels of no pair."""
    if not archived.join(packet, ["query_id", "document_id"], "left_anti").isEmpty():
        raise ValueError("a label belongs to no pair of the packet")
    labels = [c for c in archived.columns if c not in ("query_id", "document_id")]
    return packet.drop(*labels).join(archived, ["query_id", "document_id"], "left")
