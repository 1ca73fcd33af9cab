"""Shared scratch tables: how the operators of this subpackage cut lineage.

Executors come and go, so nothing is kept in an executor's own storage. An intermediate table is written as
Parquet below the folder that the cluster names in ``spark.checkpoint.dir``, and read back from there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from the session. Only where it is unset (tests and single-machine runs, where driver and executors
    are one process) a temporary folder of this process stands in, and goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="panelkit-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing uses yet; the JVM deletes it when it ends."""
    path = f"{shared_folder(spark)}/panelkit/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    return path


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._panelkit_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table of ``keep`` that no later plan reads."""
    path = getattr(df, "_panelkit_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of bounded bytes: batches bounded by rows alone grow with the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def position(df: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly this name, else the one whose name differs in case only."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name}")
    return same[0]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``names`` under their new names, whatever others there are, also ones of nearly the same name."""
    own = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return own.select(*[F.col(f"c{position(df, c)}").alias(alias) for alias, c in names.items()])


def packed(df: DataFrame) -> DataFrame:
    """Each row as one column ``row``, a struct of c0, c1, …"""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(F.struct("*").alias("row"))


def numbered(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """``docs`` with columns c0, c1, … so that any names will do, and the name of its text as a string among them."""
    small_batches(docs.sparkSession)
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    place = position(docs, text)
    if docs.dtypes[place][1] == "string":
        return own, f"c{place}"
    return own.withColumn("text", F.col(f"c{place}").cast("string")), "text"


#: Rows that one row of a task is repeated into at most.
CHUNK = 4096


def repeated(df: DataFrame, times: str, key: list[str], most: int, index: str) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0 in ``index``. ``most``: no row has more times.

    A row with more than ``CHUNK`` is dealt into ranges first, and these are spread over all tasks by ``key`` and range.
    """
    numbers = lambda d: d.withColumn(index, F.explode(F.sequence(F.col("_from"), F.col("_to")))).drop("_from", "_to")
    one = F.lit(0).cast("long")
    few = numbers(df.where(F.col(times).between(1, CHUNK)).withColumns({"_from": one, "_to": F.col(times).cast("long") - 1}))
    if most <= CHUNK:
        return few
    ranges = df.where(F.col(times) > CHUNK).withColumn("_from", F.explode(F.sequence(one, F.col(times).cast("long") - 1, F.lit(CHUNK).cast("long"))))
    ranges = ranges.withColumn("_to", F.least(F.col("_from") + CHUNK, F.col(times).cast("long")) - 1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few.unionByName(numbers(ranges.repartition(n, *key, "_from")))
