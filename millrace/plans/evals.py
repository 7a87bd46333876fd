"""Aggregates, windows, set operations, evaluation, retrieval, state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators import metrics as E
from millrace.operators import ordering as O
from millrace.operators.dialog import fold_turns
from millrace.operators.matching import dictionary
from millrace.operators.retrieve import fit_cells, fit_probes, fixed_chunks, index_vectors, nearest, nearest_indexed
from millrace.plans.base import Tables, collapse_sql, name_sql, query, sql_list

_KEY = "regexp_replace(regexp_replace(lower({c}), '[?#].*$', ''), '/+$', '')"
_GOLD = "source_system = 'manual_override'"


@query("SELECT discovery_tier AS tier, count(*) AS n, count(*) FILTER (WHERE len(coalesce(programs, [])) = 0) AS without, sum(len(coalesce(programs, [])))::BIGINT AS links FROM discovery_results GROUP BY 1")
def agg1_tiers(spark, folder):
    n = F.coalesce(F.size("programs"), F.lit(0))
    return Tables(spark, folder).discovery_results.groupBy(F.col("discovery_tier").alias("tier")).agg(F.count("*").alias("n"), F.count_if(n <= 0).alias("without"), F.sum(F.greatest(n, F.lit(0))).alias("links"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg2_histogram(spark, folder):
    return Tables(spark, folder).events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE text IS NULL) AS no_text, count(*) FILTER (WHERE length(text) < 200) AS short, count(*) FILTER (WHERE length(text) >= 200 AND contacts IS NULL) AS no_contacts, count(*) FILTER (WHERE length(text) >= 200 AND contacts IS NOT NULL) AS good FROM raw_pages""")
def agg3_outcomes(spark, folder):
    n = F.length("text")
    return Tables(spark, folder).raw_pages.agg(F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(n < 200).alias("short"), F.count_if((n >= 200) & F.col("contacts").isNull()).alias("no_contacts"), F.count_if((n >= 200) & F.col("contacts").isNotNull()).alias("good"))


_REAL = "coalesce(trim(lower({c})) NOT IN ('not found', 'not specified', '', 'none', 'n/a'), false)"


@query(f"""SELECT county_code, count(*) AS records, arg_min(health_department_contact_email, record_id) FILTER (WHERE {_REAL.format(c='health_department_contact_email')}) AS email, arg_min(health_department_contact_phone, record_id) FILTER (WHERE {_REAL.format(c='health_department_contact_phone')}) AS phone,
    string_agg(notes, ' | ' ORDER BY record_id) FILTER (WHERE trim(notes) <> '') AS notes FROM structured_counties GROUP BY 1""")
def agg5_county_rollup(spark, folder):
    real = lambda c: F.when(G.is_filled(F.col(c)), F.struct("record_id", F.col(c).alias("v")))
    notes = F.array_sort(F.collect_list(F.when(F.trim("notes") != "", F.struct("record_id", "notes"))))
    g = Tables(spark, folder).structured_counties.groupBy("county_code").agg(
        F.count("*").alias("records"), F.min(real("health_department_contact_email"))["v"].alias("email"), F.min(real("health_department_contact_phone"))["v"].alias("phone"), F.nullif(F.array_join(F.transform(notes, lambda x: x["notes"]), " | "), F.lit("")).alias("notes")
    )
    return g


_FIELDS = {"eligibility": "eligibility_requirements", "application": "application_process", "description": "program_description", "url": "program_website_url", "target": "target_population"}


@query(f"""SELECT data_version, count(*) AS n, {', '.join(f"round(avg(CASE WHEN {_REAL.format(c=c)} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, c in _FIELDS.items())},
    round(avg(CASE WHEN {' AND '.join(_REAL.format(c=c) for c in _FIELDS.values())} THEN 1.0 ELSE 0.0 END), 6) AS all_fields FROM structured_programs GROUP BY 1""")
def agg16_completeness(spark, folder):
    return E.completeness(Tables(spark, folder).structured_programs, ["data_version"], {n: G.is_filled(F.col(c)) for n, c in _FIELDS.items()})


@query("SELECT county_code, " + ", ".join(f"count(*) FILTER (WHERE data_version = 'v{i}') AS v{i}" for i in range(1, 6)) + " FROM structured_programs GROUP BY 1")
def agg13_version_pivot(spark, folder):
    names = [f"v{i}" for i in range(1, 6)]
    return Tables(spark, folder).structured_programs.groupBy("county_code").pivot("data_version", names).agg(F.count(F.lit(1))).fillna(0, names)


@query("SELECT county_code, data_version, n, delta, coalesce(delta < 0, false) AS regressed FROM (SELECT *, n - lag(n) OVER (PARTITION BY county_code ORDER BY data_version) AS delta FROM (SELECT county_code, data_version, count(*) AS n FROM structured_programs GROUP BY 1, 2))")
def win5_version_delta(spark, folder):
    return E.versions(Tables(spark, folder).structured_programs, "county_code", "data_version")


@query("SELECT year(o_orderdate) AS year, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderpriority)")
def agg13_order_rollup(spark, folder):
    t = Tables(spark, folder).orders.withColumn("year", F.year("o_orderdate").cast("long"))
    return t.rollup("year", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_FP = f"sha1(lower({collapse_sql('substr(text, 1, 2000)')}))"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_FP} ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def win1_first_by_fingerprint(spark, folder):
    t = Tables(spark, folder).documents.where("text is not null").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    return t.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"SELECT page_id, page_url FROM (SELECT page_id, page_url, row_number() OVER (PARTITION BY {_KEY.format(c='page_url')} ORDER BY scraped_at NULLS FIRST, page_id) AS rn FROM raw_pages) WHERE rn = 1")
def win2_first_by_url(spark, folder):
    t = Tables(spark, folder).raw_pages.select("page_id", "page_url", "scraped_at")
    return O.first_wins(t, [T.url_key(F.col("page_url"))], [F.col("scraped_at"), F.col("page_id")]).select("page_id", "page_url")


@query("SELECT program_uid, arg_max(record_id, record_id) AS record_id, count(*) AS n FROM structured_programs GROUP BY 1")
def win9_last_by_key(spark, folder):
    t = Tables(spark, folder).structured_programs
    return t.groupBy("program_uid").agg(F.max("record_id").alias("record_id"), F.count("*").alias("n"))


@query("SELECT page_id, county, rank FROM (SELECT page_id, county, row_number() OVER (PARTITION BY county ORDER BY coalesce(source_depth, 99), page_id) AS rank FROM raw_pages WHERE county IS NOT NULL) WHERE rank <= 30")
def win10_page_budget(spark, folder):
    t = Tables(spark, folder).raw_pages.where("county is not null").select("page_id", "county", F.coalesce("source_depth", F.lit(99)).alias("depth"))
    return O.top_per_group(t, ["county"], [F.col("depth"), F.col("page_id")], 30).select("page_id", "county", F.col("rank").cast("long").alias("rank"))


_LINKS = "(SELECT result_id, unnest(programs).url AS url, unnest(programs).link_text AS link_text, unnest(programs).score AS score FROM discovery_results)"


@query(f"SELECT result_id, url, link_text, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY score DESC NULLS LAST, url DESC NULLS LAST, link_text DESC NULLS LAST) AS rank FROM {_LINKS}) WHERE rank <= 30")
def top1_links(spark, folder):
    t = Tables(spark, folder).discovery_results.select("result_id", F.explode("programs").alias("p")).select("result_id", "p.url", "p.link_text", "p.score")
    return O.top_per_group(t, ["result_id"], [F.col(c).desc_nulls_last() for c in ("score", "url", "link_text")], 30).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT page_id, array_to_string(coalesce(pdf_links, [])[1:20], '|') AS pdfs, array_to_string(list_sort(coalesce(registry_signals, []))[1:10], '|') AS signals FROM raw_pages")
def top5_capped_lists(spark, folder):
    return Tables(spark, folder).raw_pages.select("page_id", F.array_join(F.slice(F.coalesce("pdf_links", F.array().cast("array<string>")), 1, 20), "|").alias("pdfs"), F.array_join(F.slice(F.array_sort(F.coalesce("registry_signals", F.array().cast("array<string>"))), 1, 10), "|").alias("signals"))


@query("SELECT program_id, canonical_name FROM program_registry WHERE state_specific IS NULL UNION SELECT program_id, canonical_name FROM program_registry WHERE state_specific = 'CA'")
def set2_union(spark, folder):
    t = Tables(spark, folder).program_registry
    return t.where("state_specific is null").unionByName(t.where("state_specific = 'CA'")).select("program_id", "canonical_name").distinct()


@query("SELECT DISTINCT county_code FROM structured_programs INTERSECT SELECT DISTINCT county_code FROM discovery_results")
def set3_intersect(spark, folder):
    t = Tables(spark, folder)
    return t.structured_programs.select("county_code").intersect(t.discovery_results.select("county_code"))


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set3_except_all(spark, folder):
    t = Tables(spark, folder)
    return t.orders.select("o_custkey").exceptAll(t.customer.select("c_custkey"))


@query("SELECT county_code, url FROM (SELECT county_code, url, row_number() OVER (PARTITION BY county_code ORDER BY min_ord, url) AS rn FROM (SELECT county_code, url, min(ord) AS min_ord FROM (SELECT county_code, health_dept_url AS url, 1 AS ord FROM discovery_results UNION ALL SELECT county_code, maternal_section_url, 2 FROM discovery_results UNION ALL SELECT county_code, county_url, 3 FROM discovery_results) WHERE trim(url) <> '' GROUP BY 1, 2)) WHERE rn <= 4")
def set4_seed_candidates(spark, folder):
    t = Tables(spark, folder).discovery_results
    each = F.explode(F.array(*[F.struct(F.col(c).alias("url"), F.lit(i).alias("ord")) for i, c in enumerate(("health_dept_url", "maternal_section_url", "county_url"), 1)]))
    rows = t.select("county_code", each.alias("x")).select("county_code", "x.*").where(F.trim("url") != "").groupBy("county_code", "url").agg(F.min("ord").alias("ord"))
    return O.top_per_group(rows, ["county_code"], [F.col("ord"), F.col("url")], 4).select("county_code", "url")


# Evaluation: gold are the records that were overridden by hand, found is what the other sources have.
@query(f"""WITH g AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE {_GOLD} AND program_website_url IS NOT NULL), f AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE NOT {_GOLD} AND program_website_url IS NOT NULL),
    b AS (SELECT coalesce(g.county_code, f.county_code) AS county_code, g.k IS NOT NULL AS ig, f.k IS NOT NULL AS if FROM g FULL JOIN f ON g.county_code = f.county_code AND g.k = f.k), c AS (SELECT county_code, count(*) FILTER (WHERE ig AND if) AS tp, count(*) FILTER (WHERE if AND NOT ig) AS fp, count(*) FILTER (WHERE ig AND NOT if) AS fn FROM b GROUP BY 1)
    SELECT county_code, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM c""")
def evl2_precision_recall(spark, folder):
    t = Tables(spark, folder).structured_programs.where("program_website_url is not null").withColumn("k", T.url_key(F.col("program_website_url")))
    return E.precision_recall(t.where(_GOLD), t.where(f"not {_GOLD}"), "county_code", "k")


_RANKED = f"(SELECT county_code, {_KEY.format(c='url')} AS k, row_number() OVER (PARTITION BY county_code ORDER BY score DESC NULLS LAST, url NULLS LAST) AS rank FROM (SELECT county_code, unnest(programs).url AS url, unnest(programs).score AS score FROM discovery_results))"


def _ranked(t, most: int = 20):
    """The first links of each county by score; the planner cuts groups before the shuffle."""
    own = t.discovery_results.select("county_code", F.explode("programs").alias("p")).select("county_code", "p.url", "p.score")
    top = O.top_per_group(own, ["county_code"], [F.col("score").desc_nulls_last(), F.col("url").asc_nulls_last()], most)
    return top.select("county_code", T.url_key(F.col("url")).alias("k"), "rank")


@query(f"""WITH g AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE {_GOLD} AND program_website_url IS NOT NULL), r AS (SELECT county_code, k, min(rank) AS rank FROM {_RANKED} GROUP BY 1, 2)
    SELECT g.county_code, round(count(*) FILTER (WHERE rank <= 10) / count(*)::DOUBLE, 6) AS recall_at_10, round(count(*) FILTER (WHERE rank <= 20) / count(*)::DOUBLE, 6) AS recall_at_20 FROM g LEFT JOIN r ON r.county_code = g.county_code AND r.k = g.k GROUP BY 1""")
def evl1_recall_at_k(spark, folder):
    gold = Tables(spark, folder).structured_programs.where(_GOLD).where("program_website_url is not null").select("county_code", T.url_key(F.col("program_website_url")).alias("k"))
    return E.recall_at(gold, _ranked(Tables(spark, folder)), "county_code", "k", "rank", [10, 20])


@query(f"""WITH g AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k, 1 AS rel FROM structured_programs WHERE program_website_url IS NOT NULL), r AS (SELECT r.county_code, r.rank, coalesce(g.rel, 0) AS rel FROM {_RANKED} r LEFT JOIN g ON g.county_code = r.county_code AND g.k = r.k),
    i AS (SELECT *, row_number() OVER (PARTITION BY county_code ORDER BY rel DESC, rank) AS ideal FROM r), s AS (SELECT county_code, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg FROM i GROUP BY 1)
    SELECT county_code, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM s""")
def win4_ndcg(spark, folder):
    """Only the first ten of a county leave its window; the ideal order needs no more than the number of relevant links."""
    t = Tables(spark, folder)
    gold = t.structured_programs.where("program_website_url is not null").select("county_code", T.url_key(F.col("program_website_url")).alias("k")).distinct()
    links = t.discovery_results.select("county_code", F.explode("programs").alias("p")).select("county_code", T.url_key(F.col("p.url")).alias("k"))
    counts = links.join(gold.withColumn("rel", F.lit(1)), ["county_code", "k"], "left").groupBy("county_code").agg(F.count("rel").alias("n"))
    gains = _ranked(t, 10).join(gold, ["county_code", "k"], "left_semi").groupBy("county_code").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.col("n"), F.lit(1))).cast("int")), F.lit(0.0), lambda x, i: x + 1.0 / F.log2(i + 1.0))
    return counts.join(gains, "county_code", "left").select("county_code", F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


_SET = "list_distinct(list_filter(string_split({n}, ' '), lambda w: w <> ''))"


@query(f"""WITH g AS (SELECT DISTINCT county_code, program_name AS g FROM structured_programs WHERE {_GOLD} AND program_name IS NOT NULL), f AS (SELECT DISTINCT county_code, program_name AS f FROM structured_programs WHERE NOT {_GOLD} AND program_name IS NOT NULL),
    gs AS (SELECT *, {_SET.format(n=name_sql('g'))} AS ws FROM g), fs AS (SELECT *, {_SET.format(n=name_sql('f'))} AS ws FROM f),
    p AS (SELECT gs.county_code, g, len(list_intersect(gs.ws, fs.ws))::DOUBLE AS c, len(gs.ws) AS ng, len(fs.ws) AS nf FROM gs JOIN fs USING (county_code))
    SELECT gs.county_code, gs.g AS gold_name, round(coalesce(max(CASE WHEN c > 0 THEN 2 * (c / nf) * (c / ng) / (c / nf + c / ng) END), 0), 6) AS f1 FROM gs LEFT JOIN p ON p.county_code = gs.county_code AND p.g = gs.g GROUP BY 1, 2""")
def evl7_best_f1(spark, folder):
    """JON10: fuzzy match of names within a county."""
    t = Tables(spark, folder).structured_programs.where("program_name is not null")
    return E.best_name_match(t.where(_GOLD), t.where(f"not {_GOLD}"), "county_code", "program_name", "program_name")


@query(f"""WITH g AS (SELECT program_uid, arg_max(struct_pack(n := program_name, e := eligibility_requirements, a := application_process), record_id) AS g FROM structured_programs WHERE {_GOLD} GROUP BY 1)
    SELECT s.county_code, round(avg((CASE WHEN lower(trim(coalesce(s.program_name, ''))) = lower(trim(coalesce(g.n, ''))) THEN 1 ELSE 0 END + CASE WHEN lower(trim(coalesce(s.eligibility_requirements, ''))) = lower(trim(coalesce(g.e, ''))) THEN 1 ELSE 0 END + CASE WHEN lower(trim(coalesce(s.application_process, ''))) = lower(trim(coalesce(g.a, ''))) THEN 1 ELSE 0 END) / 3.0), 6) AS exact_match
    FROM structured_programs s JOIN g USING (program_uid) WHERE NOT (s.{_GOLD}) GROUP BY 1""")
def evl3_exact_match(spark, folder):
    """JON9: the last gold of a key counts."""
    t = Tables(spark, folder).structured_programs
    gold = t.where(_GOLD).groupBy("program_uid").agg(F.max_by(F.struct(F.col("program_name").alias("n"), F.col("eligibility_requirements").alias("e"), F.col("application_process").alias("a")), "record_id").alias("g"))
    same = lambda a, b: (F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))).cast("int")
    share = (same("program_name", "g.n") + same("eligibility_requirements", "g.e") + same("application_process", "g.a")) / 3.0
    return t.where(f"not ({_GOLD})").join(gold, "program_uid").groupBy("county_code").agg(F.round(F.avg(share), 6).alias("exact_match"))


@query("""SELECT c.county_code, c.records, coalesce(d.links, 0) AS links, coalesce(p.programs, 0) AS programs FROM (SELECT county_code, count(*) AS records FROM structured_counties GROUP BY 1) c LEFT JOIN (SELECT county_code, sum(len(coalesce(programs, [])))::BIGINT AS links FROM discovery_results GROUP BY 1) d USING (county_code) LEFT JOIN (SELECT county_code, count(DISTINCT program_uid) AS programs FROM structured_programs GROUP BY 1) p USING (county_code)""")
def jon17_evaluation_frame(spark, folder):
    t = Tables(spark, folder)
    c = t.structured_counties.groupBy("county_code").agg(F.count("*").alias("records"))
    d = t.discovery_results.groupBy("county_code").agg(F.sum(F.greatest(F.coalesce(F.size("programs"), F.lit(0)), F.lit(0))).alias("links"))
    p = t.structured_programs.groupBy("county_code").agg(F.countDistinct("program_uid").alias("programs"))
    return c.join(d, "county_code", "left").join(p, "county_code", "left").fillna(0, ["links", "programs"])


@query("SELECT tier, round(avg(CASE WHEN lower(program_category) = lower(category) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM structured_programs s JOIN program_registry r ON lower(s.program_name) = lower(r.canonical_name) WHERE program_category IS NOT NULL GROUP BY 1")
def agg22_accuracy(spark, folder):
    t = Tables(spark, folder)
    own = t.structured_programs.where("program_category is not null").select(F.lower("program_name").alias("k"), "program_category")
    reg = t.program_registry.select(F.lower("canonical_name").alias("k"), "category", "tier")
    return own.join(reg, "k").groupBy("tier").agg(F.round(F.avg((F.lower("program_category") == F.lower("category")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT county_code, count(*) FILTER (WHERE lower(program_category) LIKE '%nutrition%') AS nutrition, count(*) FILTER (WHERE lower(program_category) LIKE '%oral%') AS oral, count(*) FILTER (WHERE lower(program_category) LIKE '%birth%') AS birth FROM structured_programs GROUP BY 1")
def evl14_presence(spark, folder):
    c = F.lower("program_category")
    return Tables(spark, folder).structured_programs.groupBy("county_code").agg(*[F.count_if(c.contains(w)).alias(w) for w in ("nutrition", "oral", "birth")])


@query("SELECT result_id, county_code, string_agg(DISTINCT n, '|' ORDER BY n) AS names FROM (SELECT result_id, county_code, unnest(programs).name AS n FROM discovery_results) WHERE trim(n) <> '' GROUP BY 1, 2")
def cmp2_link_names(spark, folder):
    t = Tables(spark, folder).discovery_results.select("result_id", "county_code", F.explode("programs").alias("p")).where(F.trim("p.name") != "")
    return t.groupBy("result_id", "county_code").agg(F.array_join(F.array_sort(F.collect_set("p.name")), "|").alias("names"))


@query("""WITH a AS (SELECT county_code, program_uid AS k, 1 AS p FROM structured_programs WHERE source_system = 'manual_override' UNION ALL SELECT county_code, program_uid, 2 FROM structured_programs WHERE source_system = 'llm_structurer' UNION ALL SELECT county_code, program_uid, 3 FROM structured_programs),
    m AS (SELECT county_code, min(p) AS p FROM a GROUP BY 1) SELECT county_code, p AS strategy, count(DISTINCT k) AS programs FROM a JOIN m USING (county_code, p) GROUP BY 1, 2""")
def cmp1_cascade(spark, folder):
    """JON20: of several strategies each county keeps the first that gives any row."""
    t = Tables(spark, folder).structured_programs
    p = F.explode(F.array_compact(F.array(F.when(F.col("source_system") == "manual_override", 1), F.when(F.col("source_system") == "llm_structurer", 2), F.lit(3))))
    rows = t.select("county_code", F.col("program_uid").alias("k"), p.alias("strategy")).groupBy("county_code", "strategy").agg(F.countDistinct("k").alias("programs"))
    return O.first_wins(rows, [F.col("county_code")], [F.col("strategy")])


# Chunks and neighbours.
@query("""WITH t AS (SELECT doc_id, text AS t FROM documents WHERE length(trim(text)) >= 80), s AS (SELECT doc_id, t, unnest(range(0, greatest(0, length(t) - 101) + 1, 700)) AS s FROM t), c AS (SELECT doc_id, s // 700 AS chunk_no, substr(t, s + 1, 800) AS chunk FROM s)
    SELECT doc_id, chunk_no, chunk FROM c WHERE length(trim(chunk)) >= 80""")
def win7_fixed_chunks(spark, folder):
    out = fixed_chunks(Tables(spark, folder).documents, "doc_id", F.col("text"))
    return out.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS similarity FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s) SELECT query_id, neighbour_id, rank FROM r WHERE rank <= 10""")
def top4_neighbours(spark, folder):
    """Queries are the rows whose id is divisible by 50, searched against all rows."""
    t = Tables(spark, folder).embeddings
    return nearest(t.where("vec_id % 50 = 0"), t, 10).select("query_id", "neighbour_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def top4_index_recall(spark, folder):
    """TOP4 by an index: whether it finds at least 0.9 of what the exact search finds."""
    t = Tables(spark, folder).embeddings
    q = t.where("vec_id % 50 = 0")
    centres = fit_cells(t)
    found = nearest_indexed(q, index_vectors(t, centres), centres, 10, fit_probes(t, centres)).select("query_id", "neighbour_id", F.lit(1).alias("found"))
    both = nearest(q, t, 10).join(found, ["query_id", "neighbour_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("good"))


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS n, e.label = q.label AS rel, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS sim FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, n) AS rank FROM s) SELECT query_id, count(*) FILTER (WHERE rel) AS relevant FROM r WHERE rank <= 10 GROUP BY 1""")
def evl6_retrieval_hits(spark, folder):
    t = Tables(spark, folder).embeddings
    label = t.select("vec_id", "label")
    found = nearest(t.where("vec_id % 50 = 0"), t, 10)
    joined = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(label.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("nl")), "neighbour_id")
    return joined.groupBy("query_id").agg(F.count_if(F.col("ql") == F.col("nl")).alias("relevant"))


# State.
@query("SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY 1")
def str3_accumulators(spark, folder):
    return Tables(spark, folder).events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation), e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN names[(user_id % len(names) + 1)::INT] END AS said, names FROM events, n),
    t AS (SELECT user_id, event_id, list_filter(names, lambda x: contains(lower(said), lower(x)))[1] AS named FROM e), a AS (SELECT user_id, count(*) AS n_turns, min(event_id) FILTER (WHERE named IS NOT NULL) AS k1, max(event_id) AS last FROM t GROUP BY 1),
    b AS (SELECT a.user_id, min(event_id) FILTER (WHERE named IS NULL AND event_id > k1) AS k2 FROM t JOIN a USING (user_id) GROUP BY 1), c AS (SELECT t.user_id, arg_max(named, event_id) AS county FROM t JOIN b USING (user_id) WHERE named IS NOT NULL AND event_id < coalesce(k2, 9223372036854775807) GROUP BY 1)
    SELECT user_id AS conversation, CASE WHEN k1 IS NULL THEN 'ask' WHEN k2 IS NULL THEN 'confirm' WHEN k2 = last THEN 'show' ELSE 'done' END AS step, county, n_turns FROM a LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def str4_conversations(spark, folder):
    """Events of a user as turns of a conversation: every third names a county, others say yes."""
    t = Tables(spark, folder)
    names = [r[0] for r in dictionary(t.nation.select("n_name").orderBy("n_nationkey"), "n_name")]
    said = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % len(names) + 1).cast("int"))).otherwise("yes")
    return fold_turns(t.events.select(F.col("user_id").alias("conversation"), F.col("event_id").alias("turn"), said.alias("text")), names)


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND created_at >= TIMESTAMP '2025-06-01' AND {_FP} NOT IN (SELECT {_FP} FROM documents WHERE text IS NOT NULL AND created_at < TIMESTAMP '2025-06-01')")
def str2_unseen(spark, folder):
    """Documents of a later run whose fingerprint no earlier run has."""
    t = Tables(spark, folder).documents.where("text is not null and created_at is not null").select("doc_id", "created_at", T.fingerprint(F.col("text")).alias("fp"))
    cut = F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00"))
    return t.where(F.col("created_at") >= cut).join(t.where(F.col("created_at") < cut).select("fp"), "fp", "left_anti").select("doc_id")


@query("""WITH p AS (SELECT county, page_url, page_id, length(text) AS n FROM raw_pages WHERE county IS NOT NULL), f AS (SELECT county, arg_min(page_url, page_id) AS url FROM p GROUP BY 1),
    l AS (SELECT * FROM (SELECT f.url AS src, page_url AS dst, row_number() OVER (PARTITION BY p.county ORDER BY page_id) AS pos FROM p JOIN f USING (county)) WHERE src <> dst),
    h0 AS (SELECT county, url, 0 AS depth, '' AS path FROM f), h1 AS (SELECT county, dst AS url, 1 AS depth, min(path || '/' || lpad(pos::VARCHAR, 6, '0')) AS path FROM h0 JOIN l ON url = src WHERE (county, dst) NOT IN (SELECT county, url FROM h0) GROUP BY 1, 2),
    h2 AS (SELECT county, dst AS url, 2 AS depth, min(path || '/' || lpad(pos::VARCHAR, 6, '0')) AS path FROM h1 JOIN l ON url = src WHERE (county, dst) NOT IN (SELECT county, url FROM h0 UNION ALL SELECT county, url FROM h1) GROUP BY 1, 2),
    s AS (SELECT page_url FROM p GROUP BY 1 HAVING max(n) >= 200), v AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)
    SELECT county, url, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY depth, path, url) AS rank FROM v WHERE url IN (SELECT page_url FROM s)) WHERE rank <= 30""")
def str1_crawl(spark, folder):
    """A bounded breadth-first crawl over the link tables of the pages: pages of a county link to its other pages."""
    from millrace.operators.pages import crawl

    p = Tables(spark, folder).raw_pages.where("county is not null").select("county", "page_url", "page_id", F.length("text").alias("n"))
    first = p.groupBy("county").agg(F.min_by("page_url", "page_id").alias("seed"))
    pos = F.row_number().over(W.partitionBy("county").orderBy("page_id"))
    links = p.join(first, "county").select(F.col("seed").alias("src"), F.col("page_url").alias("dst"), pos.alias("pos")).where("src <> dst")
    pages = p.groupBy(F.col("page_url").alias("url")).agg(F.lit(True).alias("expands"), (F.max("n") >= 200).alias("saved"))
    return crawl(first.select("county", F.col("seed").alias("url")), links, pages).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def str6_windowed_stream(spark, folder):
    """The events as a stream, counted by hour and kind; complete, so nothing is held back by the watermark."""
    from millrace.streaming.streams import run_once

    schema = Tables(spark, folder).events.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(_stream_path(spark, folder, "events"))
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("event_type").alias("kind"), "n")
    return run_once(counts, "events", "complete")


def _stream_path(spark, folder, table):
    """A folder with the table's files, which a stream can watch: the table itself if it is one, else a copy."""
    import os
    import uuid

    from millrace.runtime import shared_dir

    path = f"{folder}/{table}.parquet"
    if os.path.isdir(path):
        return path
    at = f"{shared_dir(spark).rstrip('/')}/millrace-source-{uuid.uuid4().hex}"
    spark.read.parquet(path).write.parquet(at)
    return at
