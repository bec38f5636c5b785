"""Shared folder handling and small helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files of a query go when it has ended


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new temporary one, but only if all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        have = sc._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
            have = sc._jsc.sc().getCheckpointDir()
        base = have.get()
    return base.rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's own folder under the shared one; that folder goes when the driver ends."""
    own = f"{shared_dir(spark)}/folio/{spark.sparkContext.applicationId}"
    fs, p = _file(spark, own)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, it survives lost executors, and its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    had = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    for tables in _scratch:
        tables.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that keep() makes meanwhile."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by keep() that nothing will read again."""
    for df in tables:
        fs, p = _file(df.sparkSession, df._folio_path)
        fs.delete(p, True)


WORDS = 18  # 64-bit words of a sieve, as a power of two


def _bit(*columns: str) -> tuple[Column, Column]:
    h = F.xxhash64(*columns)
    return F.pmod(h, F.lit(1 << WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))


def sieve(wanted: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of hashes of wanted's columns: 1 << WORDS rows (2 MB) at most, at any size. When nearly full it keeps nothing back, and nothing is lost."""
    word, bit = _bit(*columns)
    return wanted.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def sift(rows: DataFrame, bitmap: DataFrame, *columns: str, out: bool = False) -> DataFrame:
    """rows whose columns may be in the sieve; with out those that certainly are not. The sieve is broadcast."""
    word, bit = _bit(*columns)
    return rows.join(F.broadcast(bitmap), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_anti" if out else "left_semi")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
