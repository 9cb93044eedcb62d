"""Session set-up, the shared scratch folder, and joins that are broadcast only after a size check."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, once counted.
BROADCAST_ROWS = 200_000
#: Bytes of such a table, by the lengths of its values.
BROADCAST_BYTES = 40_000_000
#: Bytes of files below which spread() acts.
SMALL_FILES = 64_000_000


def get_spark(app: str = "corpusloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a local one, as in tests.

    A local folder holds only what one machine wrote, so it is refused on a cluster: a session of another master than
    ``local`` must name its folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(remove, spark, root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if the session still can."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


class Scratch:
    """Tables written into the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.turn = 0
        atexit.register(remove, spark, self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; a table saved before under this name is removed afterwards."""
        self.turn += 1
        path, old = f"{self.base}/{name}-{self.turn}", self.paths.get(name)
        df.write.mode("errorifexists").parquet(path)
        self.paths[name] = path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing lazy reads any more."""
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table that operators of this session wrote. Results that are not written yet can't be read afterwards."""
    remove(spark, f"{scratch_root(spark)}/corpusloom")


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values, about: lengths of texts, sizes of lists, 8 for all else."""
    out = F.lit(0)
    for f in df.schema:
        name, kind = f"`{f.name}`", f.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(name), F.lit(0)) + 8
        elif kind in ("array", "map"):
            out = out + F.coalesce(F.octet_length(F.to_json(name)) if kind == "map" or f.dataType.elementType.typeName() in ("string", "struct", "array") else F.size(name) * 8, F.lit(0)) + 8
        else:
            out = out + 8
    return out


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to be sent to all executors: rows counted, bytes summed."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_width(df)).alias("bytes")).first()
    return found.n <= rows and (found.bytes or 0) <= most


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join left with right, a written table: broadcast if its rows and bytes are few, else shuffled, skew left to AQE."""
    return left.join(F.broadcast(right) if fits_broadcast(right, rows) else right, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores if it is read from fewer files than there are cores, each too small to be split; else as it is.

    Work in Python on a small table would else run in as many tasks as there are files. What is shuffled is bounded by
    SMALL_FILES; keys say how rows are dealt out, so that a task that is run again gets the same.
    """
    spark = df.sparkSession
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for f in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += where.getFileSystem(conf).getFileStatus(where).getLen()
    return df.repartition(cores, *keys) if size <= SMALL_FILES else df


def need(df: DataFrame, *columns: str) -> None:
    """Raise if a column is missing or its name is not unique without regard to case."""
    names = [c.lower() for c in df.columns]
    for c in columns:
        if names.count(c.lower()) != 1:
            raise ValueError(f"column {c!r} is needed exactly once; there are {df.columns}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The columns of df called by the values, named by the keys; other columns, whatever their names, do not matter.

    A name is taken as it is written, else without regard to case; of several such columns the first. Raises if there is none.
    """
    names = df.columns
    places = []
    for c in columns.values():
        found = [i for i, n in enumerate(names) if n == c] or [i for i, n in enumerate(names) if n.lower() == c.lower()]
        if not found:
            raise ValueError(f"there is no column {c!r} in {names}")
        places.append(found[0])
    if len({n.lower() for n in names}) == len(names):
        return df.select(*[F.col(f"`{names[i]}`").alias(k) for i, k in zip(places, columns)])
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"c{i}").alias(k) for i, k in zip(places, columns)])
