"""Session helpers shared by all operators: shipping code, cutting lineage, spreading scans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="millrace-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"millrace_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, at[7:], True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now
        if path.startswith("file:"):
            shutil.rmtree(path.split(":", 1)[1].replace("//", "", 1), True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the table of stage() that df is, once nothing reads it any more."""
    if path := vars(df).get("_millrace_path"):
        _remove(df.sparkSession, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys if the scan has fewer tasks than half the cores; a scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """One row for each key. Only if a key does repeat (a check of that one column) are the rows shuffled; of rows
    with one key that differ in the other columns the one with the smallest hash of all columns stays."""
    twice = df.groupBy(key).count().where("count > 1")
    if twice.limit(1).count() == 0:
        return df
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(key).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return best.select("row.*")
