"""Matching records to a registry: dictionary scans, three passes, classification by keywords, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.terms import BLOCK_TERMS, first_aliases, first_contained, held_terms


def dictionary(df: DataFrame, *columns: str, most: int = 2_000) -> list[tuple]:
    """The rows of a dimension of fixed size (a list of places) in order, for use as literals; an error beyond the
    bound. Dictionaries that may grow go through operators.terms."""
    rows = [tuple(r) for r in df.select(*columns).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the dimension has more than {most} rows")
    return rows


def alias_dimension(registry: DataFrame, id_col: str = "program_id", aliases: tuple[str, ...] = ("county_aliases",)) -> DataFrame:
    """alias, program_id, ord: lower-cased aliases, ord in the order of ids and lists. An alias of several programs keeps
    its first place and its last program."""
    arrays = F.concat(*[F.col(a) for a in aliases])
    flat = registry.select(F.col(id_col).alias("program_id"), F.posexplode(arrays).alias("pos", "alias")).select("program_id", "pos", F.trim(F.lower("alias")).alias("alias")).where("alias <> ''")
    key = F.struct("program_id", "pos")
    return flat.groupBy("alias").agg(F.max_by("program_id", key).alias("program_id"), F.min(key).alias("first")).select("alias", "program_id", F.concat_ws("#", F.col("first.program_id"), F.lpad(F.col("first.pos").cast("string"), 4, "0")).alias("ord"))


def match_registry(df: DataFrame, aliases: DataFrame, registry: DataFrame, id_col: str, text: Column, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """id, program_id, confidence: the first alias held (1.0), else the first alias of several words all of which are
    held (0.8), else the program with most words of four letters in common with the text, two at least (0.5; the first
    in order of ids). Not matched: null and 0.0.

    One pass of the automaton over the lowered text gives the first two; only the words of rows that they leave over
    are joined with those of the names."""
    low = df.select(F.col(id_col).alias("id"), F.lower(text).alias("low"))
    passes = first_aliases(low, F.col("low"), aliases, block_terms)
    rest = passes.where("p1 is null and p2 is null").select("id", F.explode(F.array_distinct(T.tokens(F.col("low"), 4))).alias("word"))
    names = registry.select("program_id", F.explode(F.array_distinct(T.tokens(F.col("canonical_name"), 4))).alias("word"))
    shared = rest.join(names, "word").groupBy("id", "program_id").agg(F.count("*").alias("n")).where("n >= 2")
    third = shared.groupBy("id").agg(F.min_by("program_id", F.struct(-F.col("n"), "program_id")).alias("p3"))
    return passes.join(third, "id", "left").select(
        "id", F.coalesce("p1", "p2", "p3").alias("program_id"), F.when(F.col("p1").isNotNull(), 1.0).when(F.col("p2").isNotNull(), 0.8).when(F.col("p3").isNotNull(), 0.5).otherwise(0.0).alias("confidence")
    )


def enrich(matched: DataFrame, registry: DataFrame) -> DataFrame:
    """Attributes of the matched program; "UNMATCHED" where there is none."""
    own = registry.select("program_id", "tier", "blueprint_goal", F.col("canonical_name").alias("registry_canonical_name"), F.col("category").alias("registry_category"))
    return matched.join(own, "program_id", "left").withColumn("program_id", F.coalesce("program_id", F.lit("UNMATCHED")))


def classify_by(df: DataFrame, keywords: DataFrame, id_col: str, lowered: Column, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """As classify, with keywords (type, word, weight) in a table of any size; of equal types the first by name. Only the
    words that a text holds are joined to their types."""
    held = held_terms(df.select(F.col(id_col).alias("id"), lowered.alias("low")), F.col("low"), keywords.select("word"), "held", block_terms).select("id", "held")
    scores = held.select("id", F.explode("held").alias("word")).join(keywords, "word").groupBy("id", "type").agg(F.sum(F.col("weight").cast("double")).alias("score"))
    best = scores.groupBy("id").agg(F.min_by("type", F.struct(-F.col("score"), "type")).alias("type"), F.max("score").alias("score"))
    return df.select(F.col(id_col).alias("id")).join(best, "id", "left").fillna(0.0, ["score"])


def classify(df: DataFrame, keywords: list[tuple[str, str, float]], id_col: str, lowered: Column) -> DataFrame:
    """id, type, score: the type whose held keywords (type, keyword, weight; a fixed list) weigh most; of equals the
    first in the list; null and 0 if none is held. One expression a type, no rows multiplied."""
    types = list(dict.fromkeys(t for t, _, _ in keywords))
    low = df.select(F.col(id_col).alias("id"), lowered.alias("low"))
    scores = []
    for k, t in enumerate(types):
        total = F.lit(0.0)
        for own, word, weight in keywords:
            if own == t:
                total = total + F.when(F.col("low").contains(word), float(weight)).otherwise(0.0)
        scores.append(F.struct(total.alias("score"), F.lit(-k).alias("ord"), F.lit(t).alias("type")))
    best = F.array_max(F.array(*scores))
    return low.select("id", best.alias("b")).select("id", F.when(F.col("b.score") > 0, F.col("b.type")).alias("type"), F.col("b.score").alias("score"))


def exact_then_contained(df: DataFrame, aliases: DataFrame, id_col: str, name: Column, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """id, program_id: the alias that equals the normalised name, else the first alias that holds it or is held by it.
    An equality join for the first; an empty name matches nothing."""
    named = df.select(F.col(id_col).alias("id"), T.normalize_name(name).alias("name"))
    exact = first_contained(named, F.col("name"), aliases, block_terms).join(aliases.select(F.col("alias").alias("name"), F.col("program_id").alias("equal")), "name", "left")
    return exact.select("id", "name", F.when(F.col("name") != "", F.coalesce("equal", "p")).alias("program_id"))


def first_named(df: DataFrame, names: DataFrame, id_col: str, text: Column, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """id, name: the first name in alphabetical order that the text holds, in any case; rows without are left out."""
    low = df.select(F.col(id_col).alias("id"), F.lower(text).alias("low")).where("low is not null")
    by_term = names.groupBy(F.trim(F.lower("name")).alias("term")).agg(F.min("name").alias("name")).where("term <> ''")
    held = held_terms(low, F.col("low"), by_term.select("term"), "held", block_terms).select("id", F.explode("held").alias("term"))
    return held.join(by_term, "term").groupBy("id").agg(F.min("name").alias("name"))
