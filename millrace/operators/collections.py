"""Chunk collections of a source: recursive chunks, building a collection once, states that rows go through."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import ship

#: Separators, the strongest first (fixed values); the last one cuts anywhere.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_recursive(text: str, size: int = 800, overlap: int = 100, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters: the text is split at the strongest separator it holds, parts that are still
    too long at the next one, and parts are put together again up to the size; a piece begins with parts of the one
    before, up to `overlap` characters. A separator stays at the start of the part behind it; pieces are trimmed."""
    k = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[k], separators[k + 1 :]
    if sep:
        first, *others = text.split(sep)
        parts = [x for x in (first, *(sep + o for o in others)) if x]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += _joined(short, size, overlap)
        short = []
        out += split_recursive(p, size, overlap, rest) if rest else [p]
    return out + _joined(short, size, overlap)


def _joined(parts: list[str], size: int, overlap: int) -> list[str]:
    out, now, n = [], [], 0
    for p in parts:
        if n + len(p) > size and now:
            out.append("".join(now).strip())
            while now and (n > overlap or n + len(p) > size):
                n -= len(now.pop(0))
        now.append(p)
        n += len(p)
    out.append("".join(now).strip())
    return [x for x in out if x]


def recursive_chunks(df: DataFrame, id_col: str, text: Column, size: int = 800, overlap: int = 100, least: int = 80) -> DataFrame:
    """id, chunk_no, chunk by split_recursive; texts and chunks of fewer than `least` characters are left out."""
    ship(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), text.alias("t")).where(F.length(F.trim("t")) >= least)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, n, c) for i, t in enumerate(b.column(1).to_pylist()) for n, c in enumerate(x for x in split_recursive(t, size, overlap) if len(x) >= least)]
            at, numbers, chunks = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], ["id", "chunk_no", "chunk"])

    return own.mapInArrow(run, f"id {kind}, chunk_no int, chunk string")


def collection_name(county: Column) -> Column:
    return F.concat(F.lit("county_"), F.replace(F.lower(F.trim(county)), F.lit(" "), F.lit("_")))


def county_of_collection(name: Column) -> Column:
    """A county's name from that of its collection; case is lost on the way."""
    return F.initcap(F.replace(F.regexp_replace(name, "^county_", ""), F.lit("_"), F.lit(" ")))


def _exists(df: DataFrame, path: str) -> bool:
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def build_collections(chunks: DataFrame, folder: str, by: str = "collection", force: bool = False) -> DataFrame:
    """Writes chunks as one partition a collection, but for collections that are there already, unless force; gives
    collection, chunks, status ("built", "kept"). Only the partitions that are built are touched."""
    counts = chunks.groupBy(by).agg(F.count("*").alias("chunks"))
    new = chunks
    there = None
    if not force and _exists(chunks, folder):
        there = chunks.sparkSession.read.parquet(folder).select(F.col(by).cast("string").alias(by)).distinct()
        there = chunks.sparkSession.createDataFrame(there.collect(), there.schema)  # read before the folder is written
        new = chunks.join(there, by, "left_anti")
    new.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
    if there is None:
        return counts.withColumn("status", F.lit("built"))
    return counts.join(there.withColumn("status", F.lit("kept")), by, "left").withColumn("status", F.coalesce("status", F.lit("built")))


def run_states(df: DataFrame, step: Column, state_col: str = "state", most: int = 10) -> DataFrame:
    """df after at most `most` transitions: step gives the next state of a row from its state and columns (the same for
    a final state). `steps` counts the transitions a row made. All of it is one projection after another."""
    out = df.withColumn("steps", F.lit(0))
    for _ in range(most):
        out = out.withColumn("_next", step).withColumn("steps", F.col("steps") + (F.col("_next") != F.col(state_col)).cast("int")).withColumn(state_col, F.col("_next")).drop("_next")
    return out
