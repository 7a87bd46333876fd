"""Chunks of documents and nearest neighbours of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import top_per_group
from millrace.runtime import ship

#: Query vectors in one broadcast block, at most.
BLOCK_QUERIES = 20_000


def fixed_chunks(df: DataFrame, id_col: str, text: Column, size: int = 800, overlap: int = 100, least: int = 80) -> DataFrame:
    """id, chunk_no, chunk: windows of `size` characters, each `overlap` before the end of the last; texts and chunks of
    fewer than `least` characters are left out."""
    t = df.select(F.col(id_col).alias("id"), text.alias("t")).where(F.length(F.trim("t")) >= least)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("t") - overlap - 1), F.lit(size - overlap))
    chunks = t.select("id", F.posexplode(starts).alias("chunk_no", "s"), "t").select("id", "chunk_no", F.substring("t", F.col("s") + 1, F.lit(size)).alias("chunk"))
    return chunks.where(F.length(F.trim("chunk")) >= least)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, neighbour_id, similarity, rank: the k nearest by cosine, exact, other than the query itself.

    The queries, a stated set, are broadcast in blocks of bounded size; each task of vectors keeps the best k of its
    own for each query, so what is shuffled is k rows a query and task. Null and zero vectors have no neighbours."""
    spark = vectors.sparkSession
    ship(spark)
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    n = q.count()
    blocks = max(1, -(-n * 5 // (4 * block_queries)))
    parts = []
    for i in range(blocks):
        rows = (q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else q).collect()
        if not rows:
            continue
        kept = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64))))
        parts.append(_scan(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null"), kept, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per_group(out, ["query_id"], [F.col("similarity").desc(), F.col("neighbour_id")], k)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows, without a Python object a number; all must have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _scan(vectors: DataFrame, kept, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = kept.value
        best_s, best_i = np.full((len(ids), 0), -2.0), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            if not len(b):
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            m = _matrix(b.column(1))
            # rounded, so that ties are ties in whatever order sums are made
            s = np.round(q @ _unit(m).T, 9)
            s[ids[:, None] == own[None, :]] = -2.0
            best_s, best_i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(own, s.shape)])
            order = np.lexsort((best_i, -best_s))[:, :k]
            best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        good = best_s > -2.0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(axis=1))), pa.array(best_i[good]), pa.array(best_s[good])], ["query_id", "neighbour_id", "similarity"])

    return vectors.mapInArrow(run, "query_id long, neighbour_id long, similarity double")


#: Vectors that the centres of an index are fitted on, at most, by the hash of their ids.
SAMPLE_VECTORS = 50_000


def _sample(vectors: DataFrame, id_col: str, vector_col: str, most: int) -> tuple[int, np.ndarray]:
    """The number of vectors, and at most so many of them as unit vectors, by the hash of their ids."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    n = own.count()
    share = min(1.0, most / max(n, 1))
    rows = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).orderBy(F.xxhash64("id")).limit(most).collect()
    return n, _unit(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def fit_cells(vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE_VECTORS, rounds: int = 12) -> np.ndarray:
    """Centres of an index, unit vectors: k-means by cosine on a bounded sample. cells: the square root of the number of
    vectors, 4,096 at most, unless given."""
    n, m = _sample(vectors, id_col, vector_col, sample)
    k = min(cells or max(1, min(4096, int(n**0.5))), len(m))
    centres = m[:k].copy()
    for _ in range(rounds if k else 0):
        of = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        count = np.bincount(of, minlength=k)
        centres = np.where(count[:, None] > 0, _unit(sums), centres)
    return centres


def fit_probes(vectors: DataFrame, centres: np.ndarray, recall: float = 0.95, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE_VECTORS, asked: int = 200) -> int:
    """The least number of cells in which at least this share of the k nearest of some vectors of a bounded sample lies;
    vectors without structure need most of the cells."""
    _, m = _sample(vectors, id_col, vector_col, sample)
    if not len(m) or not len(centres):
        return 1
    of, q = (m @ centres.T).argmax(axis=1), m[:asked]
    best = np.argsort(-(q @ m.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, of[best], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def index_vectors(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v, cell: every vector with the number of its nearest centre. Written partitioned by cell it is the index."""
    ship(vectors.sparkSession)
    kept = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cell = (_unit(_matrix(b.column(1))) @ kept.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    return own.mapInArrow(run, "id long, v array<double>, cell int")


def nearest_indexed(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, neighbour_id, similarity, rank as nearest, but each query is compared with the vectors of the `probes`
    cells nearest to it only: approximate, all vectors are indexed. Queries go in blocks of bounded size."""
    spark = index.sparkSession
    ship(spark)
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    blocks = max(1, -(-q.count() * 5 // (4 * block_queries)))
    out = spark.createDataFrame([], "query_id long, neighbour_id long, similarity double")
    for i in range(blocks):
        rows = (q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else q).collect()
        if not rows or not len(centres):
            continue
        ids, m = np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64))
        near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
        of: dict[int, np.ndarray] = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
        kept = spark.sparkContext.broadcast((ids, m, of))

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            ids, m, of = kept.value
            for b in batches:
                own, vectors, cell = b.column(0).to_numpy(zero_copy_only=False), None, b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    asked = of.get(c)
                    if asked is None:
                        continue
                    vectors = _unit(_matrix(b.column(1))) if vectors is None else vectors
                    at = np.flatnonzero(cell == c)
                    s = np.round(m[asked] @ vectors[at].T, 9)
                    s[ids[asked][:, None] == own[at][None, :]] = -2.0
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    best = np.take_along_axis(s, top, 1)
                    good = best > -2.0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asked], good.sum(axis=1))), pa.array(own[at][top][good]), pa.array(best[good])], ["query_id", "neighbour_id", "similarity"])

        wanted = index.where(F.col("cell").isin(sorted(of))) if len(of) < len(centres) and len(of) <= 1000 else index
        out = out.unionByName(wanted.select("id", "v", "cell").mapInArrow(run, "query_id long, neighbour_id long, similarity double"))
    return top_per_group(out, ["query_id"], [F.col("similarity").desc(), F.col("neighbour_id")], k)
