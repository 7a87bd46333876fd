"""From links to programs: scored extraction, seed pages, picks from search results, sources of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators.matching import classify_by
from millrace.operators.ordering import first_wins, top_per_group
from millrace.operators.terms import held_terms


def both_texts(url: Column, link_text: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(link_text, F.lit("")), F.coalesce(url, F.lit(""))))


def scored_links(links: DataFrame, aliases: DataFrame, keywords: DataFrame, excluded: list[str]) -> DataFrame:
    """links (with url, link_text) and their score."""
    both = both_texts(F.col("url"), F.col("link_text"))
    held = held_terms(held_terms(links, both, aliases, "_aliases"), both, keywords, "_words")
    return held.withColumn("score", G.link_score(F.col("url"), F.col("link_text"), F.col("_aliases"), F.col("_words"), excluded)).drop("_aliases", "_words")


def program_links(scored: DataFrame, group: str, keywords: DataFrame, least_score: float = 1.0, most: int = 30, external: bool = False) -> DataFrame:
    """group, url, link_text, score, rank, category of the program links among scored (group, ord, base, url, link_text,
    score).

    Links to other domains are left out unless external; below least_score a link counts as 0.2 if the search is relaxed
    (least_score 0.1 at most) and it holds a basic word, else it is left out; of a URL the first link that is kept
    counts; the rest is sorted by score, URL and text, all descending, and cut at `most` a group. The category is that
    of the text and URL by keywords (type, word, weight), "Unknown" without any."""
    own = scored if external else scored.where(T.same_domain(F.col("base"), F.col("url")))
    rescued = F.when(F.col("score") >= least_score, F.col("score"))
    if least_score <= 0.1:
        rescued = rescued.when(T.holds_any(both_texts(F.col("url"), F.col("link_text")), G.BASIC_KEYWORDS), 0.2)
    kept = own.withColumn("score", rescued).where("score is not null").select(group, "ord", "url", F.coalesce("link_text", F.lit("")).alias("link_text"), "score")
    first = first_wins(kept, [F.col(group), F.col("url")], [F.col("ord")])
    top = top_per_group(first, [group], [F.col(c).desc() for c in ("score", "url", "link_text")], most)
    keyed = top.withColumn("_key", F.struct(group, "rank"))
    types = classify_by(keyed, keywords, "_key", both_texts(F.col("url"), F.col("link_text"))).select(F.col("id").alias("_key"), "type")
    return keyed.join(types, "_key").select(group, "url", "link_text", F.round("score", 2).alias("score"), "rank", F.coalesce("type", F.lit("Unknown")).alias("category"))


def seed_programs(pages: DataFrame, id_col: str, keywords: DataFrame, words: DataFrame) -> DataFrame:
    """id, name, category, score of the seed pages (id, url, heading, title, text) that are program pages themselves: no
    PDFs, with a category by keywords or a basic word in URL, name or text. score: 2 and twice the relevance."""
    name = F.coalesce(F.nullif(F.trim("heading"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.lit("Maternal Program"))
    own = pages.where(F.coalesce(~G.is_pdf_link(F.col("url"), anywhere=True), F.lit(True))).select(F.col(id_col).alias("id"), name.alias("name"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    low = held_terms(own.withColumn("low", both_texts(F.col("url"), F.col("text"))), F.col("low"), words, "held")
    basic = T.holds_any(F.concat_ws(" ", F.col("low"), F.lower("name")), G.BASIC_KEYWORDS)
    judged = low.select("id", "name", basic.alias("basic"), F.round(2.0 + 2.0 * G.relevance(F.col("low"), F.col("held")), 2).alias("score"), "low")
    types = classify_by(judged, keywords, "id", F.col("low")).select("id", "type")
    return judged.join(types, "id").where("basic or type is not null").select("id", "name", F.coalesce("type", F.lit("Unknown")).alias("category"), "score")


def county_domain(url: Column) -> Column:
    """The host of a county's website without www."""
    return F.nullif(F.regexp_replace(T.url_host(url), r"^www\.", ""), F.lit(""))


def pick_result(results: DataFrame, group: str) -> DataFrame:
    """group, url: the pick among search results (group, template, pos, url, domain): templates in order, within one the
    first result on the county's own domain, else the first of a government host; never a PDF."""
    own = F.col("domain").isNotNull() & F.col("url").contains(F.col("domain"))
    good = results.where(F.col("url").isNotNull() & (F.col("url") != "") & ~F.lower("url").contains("pdf")).withColumn("_own", own)
    able = good.where(F.col("_own") | F.lower("url").rlike(r"\.(gov|us)(/|$)"))
    return able.groupBy(group).agg(F.min_by("url", F.struct("template", (~F.col("_own")).alias("other"), "pos")).alias("url"))


def candidate_results(results: DataFrame, group: str, most: int = 6) -> DataFrame:
    """group, url, rank: the first `most` different results, in order of templates and places, on the county's domain, or
    of government hosts where the domain is not known; no PDFs."""
    own = F.when(F.col("domain").isNotNull(), F.col("url").contains(F.col("domain"))).otherwise(F.lower("url").rlike(r"\.(gov|us)(/|$)"))
    good = results.where(F.col("url").startswith("http") & ~F.lower("url").contains("pdf") & own)
    first = good.groupBy(group, "url").agg(F.min(F.struct("template", "pos")).alias("o"))
    return top_per_group(first, [group], [F.col("o"), F.col("url")], most).select(group, "url", F.col("rank").cast("long").alias("rank"))


def cascade(strategies: list[tuple[str, DataFrame]], group: str) -> DataFrame:
    """The rows of the first strategy (label, rows) that gives any for the group, with the label in tier."""
    rows = None
    for k, (label, df) in enumerate(strategies):
        own = df.withColumns({"tier": F.lit(label), "_p": F.lit(k)})
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy(group).agg(F.min("_p").alias("_p"))
    return rows.join(first, [group, "_p"], "left_semi").drop("_p")


def else_from(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """The rows of first, and those of second for groups that first does not have."""
    return first.unionByName(second.join(first.select(group).distinct(), group, "left_anti"))


def name_matches(gold: DataFrame, found: DataFrame, group: str, gold_name: str, found_name: str, least: float = 0.0) -> DataFrame:
    """group, gold_name, found_name, f1 of the pairs of names of a group with a token F1 above 0 and of `least` at least.

    Names that share no word have F1 0, so pairs come from a join on words, each pair once, whatever the number of
    names in a group; only distinct names are compared."""
    split = lambda c: F.array_distinct(F.filter(F.split(T.normalize_name(F.col(c)), " "), lambda w: w != ""))
    g = gold.select(group, F.col(gold_name).alias("gold_name")).distinct().select(group, "gold_name", split("gold_name").alias("w"))
    f = found.select(group, F.col(found_name).alias("found_name")).distinct().select(group, "found_name", split("found_name").alias("w"))
    gw = g.select(group, "gold_name", F.size("w").alias("ng"), F.explode("w").alias("word"))
    fw = f.select(group, "found_name", F.size("w").alias("nf"), F.explode("w").alias("word"))
    pairs = gw.join(fw, [group, "word"]).groupBy(group, "gold_name", "found_name", "ng", "nf").agg(F.count("*").cast("double").alias("n"))
    p, r = F.col("n") / F.col("nf"), F.col("n") / F.col("ng")
    return pairs.select(group, "gold_name", "found_name", (2 * p * r / (p + r)).alias("f1")).where(F.col("f1") >= least)
