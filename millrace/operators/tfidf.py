"""TF-IDF over a registry: fit, transform, best match, windows of texts, gap report."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordering import top_per_group
from millrace.runtime import ship


def corpus(registry: DataFrame) -> DataFrame:
    """doc_id, text: name, acronym, population, services and aliases of each program."""
    parts = F.concat_ws(" ", "canonical_name", "acronym", F.coalesce("target_population", F.lit("")), F.array_join("core_services", " "), F.array_join("county_aliases", " "))
    return registry.select(F.col("program_id").alias("doc_id"), F.lower(parts).alias("text"))


def term_counts(df: DataFrame, id_col: str, text: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """id, term, tf: the share of a term of three letters or more in the terms of the text. With a vocabulary (term)
    other terms are dropped before anything is counted or shuffled, though they count in the share."""
    terms = df.select(F.col(id_col).alias("id"), T.tokens(text, 3).alias("t"))
    each = terms.select("id", F.size("t").alias("n"), F.explode("t").alias("term"))
    if vocabulary is not None:
        each = each.join(vocabulary.select("term"), "term", "left_semi")
    return each.groupBy("id", "term").agg((F.count("*") / F.first("n")).alias("tf"))


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """term, idf: ln((n + 1) / (df + 1)) + 1."""
    return counts.groupBy("term").agg((F.log((F.lit(n_docs) + 1.0) / (F.count("*") + 1.0)) + 1.0).alias("idf"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors id, term, w, norm; idf term, idf) of a corpus."""
    counts = term_counts(docs, id_col, F.col(text_col))
    weights = idf(counts, docs.count())
    return vectors(counts, weights), weights


def vectors(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """id, term, w, norm; terms without a weight are left out of the vector, though they count in the term's share."""
    v = counts.join(weights, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return v.join(v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "id")


def similarities(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """id, doc_id, score: cosine of each query with each document that shares a term; joined on terms, so nothing is
    compared that has nothing in common. The vectors of a registry are small; the planner broadcasts them."""
    d = docs.select(F.col("id").alias("doc_id"), "term", F.col("w").alias("dw"), F.col("norm").alias("dn"))
    return queries.join(d, "term").groupBy("id", "doc_id").agg((F.sum(F.col("w") * F.col("dw")) / (F.first("norm") * F.first("dn"))).alias("score"))


def best_match(queries: DataFrame, docs: DataFrame, threshold: float = 0.2) -> DataFrame:
    """id, program_id, score: the best document, of equals the first by id; below the threshold the id is null, the
    score stays."""
    best = similarities(queries, docs).withColumn("score", F.round("score", 6)).groupBy("id").agg(F.max(F.struct("score")).alias("m"), F.min_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("d"))
    return best.select("id", F.when(F.col("m.score") >= threshold, F.col("d")).alias("program_id"), F.col("m.score").alias("score"))


def word_windows(df: DataFrame, id_col: str, text: Column, size: int = 60, step: int = 30) -> DataFrame:
    """id, start, window: stretches of words; the words behind the last full step may be in none, as the last start is
    below n - size."""
    w = df.select(F.col(id_col).alias("id"), T.words(text).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("w") - size) - 1, F.lit(step))
    return w.select("id", F.explode(starts).alias("start"), "w").select("id", "start", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("window"))


#: Up to so many weights (a term in a document) are broadcast to score windows in one pass; beyond, terms are joined.
BROADCAST_WEIGHTS = 1_000_000
_SPACES = re.compile("[ \\t\\n\\x0b\\f\\r]+")
_TERMS = re.compile("[a-z]{3,}")


def scan_windows(pages: DataFrame, absent: DataFrame, docs: DataFrame, weights: DataFrame, id_col: str, text: Column, threshold: float = 0.38, size: int = 60, broadcast_weights: int = BROADCAST_WEIGHTS) -> DataFrame:
    """id, program_id, start, score: for each page and absent program the best window (of `size` words, half of them
    shared with the next), if it reaches the threshold; of equal scores (of six digits) the first.

    A registry's weights are broadcast, if they are not many, and all windows of a text are scored in one pass over it:
    terms are counted by half windows, and a product of two small matrices gives the scores. Only the best windows leave
    the task. Larger vocabularies are joined on terms."""
    few = docs.join(absent.select(F.col("program_id").alias("id")), "id", "left_semi")
    if few.count() > broadcast_weights or weights.count() > broadcast_weights:
        w = word_windows(pages, id_col, text, size, size // 2).withColumn("key", F.struct("id", "start"))
        q = vectors(term_counts(w, "key", F.col("window"), weights), weights)
        scored = similarities(q, few).select(F.col("id.id").alias("id"), F.col("id.start").alias("start"), F.col("doc_id").alias("program_id"), F.round("score", 6).alias("score"))
        best = scored.groupBy("id", "program_id").agg(F.min_by("start", F.struct(-F.col("score"), "start")).alias("start"), F.max("score").alias("score"))
        return best.where(F.col("score") >= threshold)
    spark = pages.sparkSession
    ship(spark)
    term_of = {t: i for i, t in enumerate(sorted(r[0] for r in weights.select("term").collect()))}
    idf_of = np.zeros(len(term_of))
    for t, x in weights.select("term", "idf").collect():
        idf_of[term_of[t]] = x
    rows = few.select("id", "term", "w", "norm").collect()
    programs = sorted({r[0] for r in rows})
    at = {p: i for i, p in enumerate(programs)}
    matrix = np.zeros((len(term_of), len(programs)))
    for p, t, x, norm in rows:
        matrix[term_of[t], at[p]] = x / norm
    kept = spark.sparkContext.broadcast((term_of, idf_of, matrix, programs))
    half = size // 2

    def best_windows(t: str) -> list[tuple[str, int, float]]:
        known, idf_, m, names = kept.value
        words = [w for w in _SPACES.split(t.lower()) if w]
        places, terms = [], []
        for i, w in enumerate(words):
            for x in _TERMS.findall(w):
                k = known.get(x)
                if k is not None:
                    places.append(i)
                    terms.append(k)
        if not terms:
            return []
        n = -(-max(1, len(words) - size) // half)  # windows
        own, col = np.unique(np.array(terms), return_inverse=True)
        counts = np.zeros((n + 1, len(own)))
        block = np.array(places) // half
        inside = block <= n
        np.add.at(counts, (block[inside], col[inside]), 1.0)
        v = (counts[:-1] + counts[1:]) * idf_[own]
        norm = np.sqrt((v * v).sum(axis=1))
        norm[norm == 0] = np.inf
        scores = np.round((v @ m[own]) / norm[:, None], 6)
        first = scores.argmax(axis=0)
        return [(names[p], int(first[p]) * half, float(scores[first[p], p])) for p in np.flatnonzero(scores.max(axis=0) >= max(threshold, 1e-6))]

    kind = pages.select(F.col(id_col).alias("id")).schema["id"].dataType

    def run(batches):
        for b in batches:
            out = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) if t for x in best_windows(t)]
            rows, names, starts, scores = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(scores, pa.float64())], ["id", "program_id", "start", "score"])

    return pages.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind.simpleString()}, program_id string, start int, score double")


def gap_candidates(events: DataFrame) -> DataFrame:
    """The unmatched events (county, url, name, program_id, semantic_match, semantic_score, sample, services, ord) grouped
    by normalised name and scored: 0.4 spread over counties, 0.3 frequency, 0.3 novelty.

    Of each group: the first name; the match of the best score (the first event of equals); the first sample that is not
    empty; the more frequent signal (of equals the one met first); the first five URLs in alphabetical order and the
    first six services in order of events. The lists are cut in each task before anything is collected."""
    signal = F.when(F.col("program_id").isNull(), "unmatched_extraction").when(F.col("semantic_match").isNotNull() & (F.col("semantic_match") != F.col("program_id")), "llm_alias_disagreement").otherwise("matched")
    all_counties = events.agg(F.countDistinct("county").alias("all_counties"))
    gaps = events.withColumn("signal", signal).where("signal <> 'matched'").withColumn("norm_name", T.normalize_name(F.col("name")))
    n_unmatched, unmatched_first = F.count_if(F.col("signal") == "unmatched_extraction"), F.min_by("signal", "ord") == "unmatched_extraction"
    grouped = gaps.groupBy("norm_name").agg(
        F.min_by("name", "ord").alias("extracted_name"), F.countDistinct("county").alias("n_counties"), F.count("*").alias("frequency"), F.max("semantic_score").alias("semantic_score"),
        F.min_by("semantic_match", F.struct(-F.col("semantic_score"), "ord")).alias("semantic_match"), F.min_by("sample", F.when(F.trim("sample") != "", F.col("ord"))).alias("sample_text"),
        F.when(n_unmatched * 2 == F.count("*"), unmatched_first).otherwise(n_unmatched * 2 > F.count("*")).alias("unmatched"),
    )
    urls = _first_few(gaps.where("url is not null").select("norm_name", "url").distinct(), "url", [F.col("url")], 5, "source_urls")
    each = gaps.select("norm_name", "ord", F.posexplode("services").alias("pos", "service")).groupBy("norm_name", "service").agg(F.min(F.struct("ord", "pos")).alias("o"))
    services = _first_few(each, "service", [F.col("o"), F.col("service")], 6, "services")
    score = (
        F.least(F.col("n_counties") / F.greatest(F.col("all_counties"), F.lit(1)), F.lit(1.0)) * 0.4
        + F.least(F.log1p("frequency") / F.log1p(F.lit(20.0)), F.lit(1.0)) * 0.3
        + (1.0 - F.least("semantic_score", F.lit(1.0))) * 0.3
    )
    whole = grouped.join(urls, "norm_name", "left").join(services, "norm_name", "left").crossJoin(F.broadcast(all_counties))
    none = F.array().cast("array<string>")
    return whole.select(
        "norm_name", "extracted_name", "n_counties", "frequency", "semantic_match", "semantic_score", "sample_text", F.coalesce("source_urls", none).alias("source_urls"), F.coalesce("services", none).alias("services"),
        F.when(F.col("unmatched"), "unmatched_extraction").otherwise("llm_alias_disagreement").alias("signal_type"),
        gap_label(F.col("semantic_score")).alias("label"), F.round(score, 6).alias("gap_score"),
    )


def _first_few(rows: DataFrame, value: str, order: list[Column], most: int, out: str) -> DataFrame:
    """norm_name, out: the first `most` values of each name, in order."""
    top = top_per_group(rows, ["norm_name"], order, most)
    return top.groupBy("norm_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(out))


def gap_label(score: Column) -> Column:
    return F.when(score >= 0.65, "likely alias").when(score >= 0.4, "possible variant").otherwise("new program")
