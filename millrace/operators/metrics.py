"""Measures of retrieval and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def precision_recall(gold: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """group, tp, fp, fn, precision, recall of the distinct keys of each group, by one full join."""
    g = gold.select(group, key).distinct().withColumn("in_gold", F.lit(1))
    f = found.select(group, key).distinct().withColumn("in_found", F.lit(1))
    both = g.join(f, [group, key], "full").fillna(0, ["in_gold", "in_found"])
    counts = both.groupBy(group).agg(F.sum(F.col("in_gold") * F.col("in_found")).alias("tp"), F.sum((1 - F.col("in_gold")) * F.col("in_found")).alias("fp"), F.sum(F.col("in_gold") * (1 - F.col("in_found"))).alias("fn"))
    return counts.withColumns({"precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6)})


def recall_at(gold: DataFrame, ranked: DataFrame, group: str, key: str, rank: str, ks: list[int]) -> DataFrame:
    """group, recall_at_k...: the share of gold keys among the first k; groups without gold have none."""
    g = gold.select(group, key).distinct()
    r = ranked.groupBy(group, key).agg(F.min(rank).alias("_rank"))
    joined = g.join(r, [group, key], "left")
    return joined.groupBy(group).agg(*[F.round(F.count_if(F.col("_rank") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in ks])


def ndcg(ranked: DataFrame, group: str, rank: str, relevant: str, k: int) -> DataFrame:
    """group, ndcg: the ideal order is that of the retrieved items only, so what was missed costs nothing."""
    ideal = F.row_number().over(W.partitionBy(group).orderBy(F.col(relevant).desc(), rank))
    gain = lambda r: F.when(r <= k, F.col(relevant) / F.log2(r + 1.0)).otherwise(0.0)
    sums = ranked.withColumn("_ideal", ideal).groupBy(group).agg(F.sum(gain(F.col(rank))).alias("dcg"), F.sum(gain(F.col("_ideal"))).alias("idcg"))
    return sums.select(group, F.round(ratio(F.col("dcg"), F.col("idcg")), 6).alias("ndcg"))


def best_name_match(gold: DataFrame, found: DataFrame, group: str, gold_name: str, found_name: str) -> DataFrame:
    """group, gold_name, f1: for each gold name the best token F1 among the names found in its group. Names meet only
    if they share a word, which any F1 over 0 requires."""
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(T.normalize_name(F.col(c)), " "), lambda w: w != "")))
    size = lambda c: F.size(F.array_distinct(F.filter(F.split(T.normalize_name(F.col(c)), " "), lambda w: w != "")))
    names = gold.select(group, F.col(gold_name).alias("g")).distinct().withColumn("ng", size("g"))
    others = found.select(group, F.col(found_name).alias("f")).distinct().withColumn("nf", size("f"))
    pairs = names.withColumn("w", word("g")).join(others.withColumn("w", word("f")), [group, "w"]).groupBy(group, "g", "f").agg(F.count("*").alias("c"), F.first("ng").alias("ng"), F.first("nf").alias("nf"))
    p, r = F.col("c") / F.col("nf"), F.col("c") / F.col("ng")
    best = pairs.withColumn("f1", 2 * p * r / (p + r)).groupBy(group, "g").agg(F.max("f1").alias("f1"))
    return names.join(best, [group, "g"], "left").select(group, F.col("g").alias("gold_name"), F.round(F.coalesce("f1", F.lit(0.0)), 6).alias("f1"))


def completeness(df: DataFrame, group: list[str], filled: dict[str, Column]) -> DataFrame:
    """group, n, the share of filled values of each field, and of rows with all of them."""
    every = F.lit(True)
    for c in filled.values():
        every = every & c
    shares = [F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in filled.items()]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *shares, F.round(F.avg(every.cast("double")), 6).alias("all_fields"))


def versions(df: DataFrame, group: str, version: str) -> DataFrame:
    """group, version, n, delta to the version before, regressed: fewer rows than before."""
    counts = df.groupBy(group, version).agg(F.count("*").alias("n"))
    before = F.lag("n").over(W.partitionBy(group).orderBy(version))
    return counts.withColumn("delta", F.col("n") - before).withColumn("regressed", F.coalesce(F.col("delta") < 0, F.lit(False)))
