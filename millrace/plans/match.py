"""Joins, matching, TF-IDF, gap report."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import matching as M
from millrace.operators import tfidf as I
from millrace.operators.terms import held_terms
from millrace.plans.base import Tables, collapse_sql, name_sql, query
from millrace.runtime import spread, stage

_ALIAS_DIM = """flat AS (SELECT program_id, unnest(county_aliases) AS a, unnest(range(0, len(county_aliases))) AS pos FROM program_registry),
    ad AS (SELECT trim(lower(a)) AS alias, max_by(program_id, program_id || lpad(pos::VARCHAR, 4, '0')) AS program_id, min(program_id || '#' || lpad(pos::VARCHAR, 4, '0')) AS ord FROM flat WHERE trim(a) <> '' GROUP BY 1)"""
_TEXT = "lower(concat_ws(' ', program_name, program_description))"
_W4 = "list_distinct(regexp_extract_all({c}, '[a-z]{{4,}}'))"
_MATCH = f"""{_ALIAS_DIM}, p AS (SELECT record_id, {_TEXT} AS low FROM structured_programs),
    p1 AS (SELECT record_id, arg_min(program_id, ord) AS p1 FROM p JOIN ad ON contains(low, alias) GROUP BY 1),
    p2 AS (SELECT record_id, arg_min(program_id, ord) AS p2 FROM p JOIN ad ON len(string_split(alias, ' ')) > 1 AND len(list_filter(string_split(alias, ' '), lambda w: NOT contains(low, w))) = 0 GROUP BY 1),
    w AS (SELECT record_id, unnest({_W4.format(c='low')}) AS word FROM p), n AS (SELECT program_id, unnest({_W4.format(c='lower(canonical_name)')}) AS word FROM program_registry),
    s AS (SELECT record_id, program_id, count(*) AS n FROM w JOIN n USING (word) GROUP BY 1, 2 HAVING count(*) >= 2), p3 AS (SELECT record_id, arg_min(program_id, lpad((1000 - n)::VARCHAR, 5, '0') || program_id) AS p3 FROM s GROUP BY 1),
    m AS (SELECT record_id, coalesce(p1, p2, p3) AS program_id, CASE WHEN p1 IS NOT NULL THEN 1.0 WHEN p2 IS NOT NULL THEN 0.8 WHEN p3 IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM p LEFT JOIN p1 USING (record_id) LEFT JOIN p2 USING (record_id) LEFT JOIN p3 USING (record_id))"""


def _matched(spark, folder):
    t = Tables(spark, folder)
    return M.match_registry(t.structured_programs, M.alias_dimension(t.program_registry), t.program_registry, "record_id", F.concat_ws(" ", "program_name", "program_description"))


@query(f"WITH {_MATCH} SELECT record_id, program_id, confidence FROM m")
def jon5_match_registry(spark, folder):
    """Passes of JON2 to JON4, the first that matches counts."""
    return _matched(spark, folder).select(F.col("id").alias("record_id"), "program_id", "confidence")


@query(f"WITH {_ALIAS_DIM} SELECT record_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM structured_programs JOIN ad ON contains({_TEXT}, alias) GROUP BY 1")
def jon1_alias_scan(spark, folder):
    t = Tables(spark, folder)
    low = t.structured_programs.select("record_id", F.lower(F.concat_ws(" ", "program_name", "program_description")).alias("low"))
    return held_terms(low, F.col("low"), M.alias_dimension(t.program_registry).select("alias")).select("record_id", F.array_join("held", "|").alias("aliases")).where("aliases <> ''")


@query(f"""WITH {_ALIAS_DIM}, p AS (SELECT record_id, {name_sql('program_name')} AS name FROM structured_programs), e AS (SELECT p.*, ad.program_id AS equal FROM p LEFT JOIN ad ON ad.alias = name),
    c AS (SELECT record_id, arg_min(program_id, ord) AS held FROM p JOIN ad ON name <> '' AND (contains(name, alias) OR contains(alias, name)) GROUP BY 1)
    SELECT record_id, name, CASE WHEN name <> '' THEN coalesce(equal, held) END AS program_id FROM e LEFT JOIN c USING (record_id)""")
def jon6_exact_or_contained(spark, folder):
    t = Tables(spark, folder)
    out = M.exact_then_contained(t.structured_programs, M.alias_dimension(t.program_registry), "record_id", F.col("program_name"))
    return out.select(F.col("id").alias("record_id"), "name", "program_id")


@query(f"WITH {_MATCH} SELECT record_id, coalesce(m.program_id, 'UNMATCHED') AS program_id, confidence, tier, blueprint_goal, canonical_name AS registry_canonical_name, category AS registry_category FROM m LEFT JOIN program_registry r ON r.program_id = m.program_id")
def prj10_enriched(spark, folder):
    return M.enrich(_matched(spark, folder), Tables(spark, folder).program_registry).withColumnRenamed("id", "record_id")


_CLASSIFY = f"""k AS (SELECT category_id, unnest(also_written) AS w FROM category_list), kw AS (SELECT category_id, trim(lower(w)) AS w, len(string_split(trim(w), ' ')) AS weight FROM k),
    p AS (SELECT record_id, {_TEXT} AS low FROM structured_programs), s AS (SELECT record_id, category_id, sum(weight) AS score FROM p JOIN kw ON contains(low, w) GROUP BY 1, 2)"""


@query(f"WITH {_CLASSIFY}, b AS (SELECT record_id, arg_min(category_id, lpad((1000 - score)::BIGINT::VARCHAR, 5, '0') || category_id) AS type, max(score) AS score FROM s GROUP BY 1) SELECT record_id, type, coalesce(score, 0)::DOUBLE AS score FROM p LEFT JOIN b USING (record_id)")
def prj6_classified(spark, folder):
    """Categories by their keywords, each weighing its words; PRJ8 is the same with other weights."""
    t = Tables(spark, folder)
    words = t.category_list.select(F.col("category_id").alias("type"), F.explode("also_written").alias("w")).select("type", F.trim(F.lower("w")).alias("word"), F.size(F.split(F.trim("w"), " ")).alias("weight"))
    low = F.lower(F.concat_ws(" ", "program_name", "program_description"))
    return M.classify_by(t.structured_programs, words, "record_id", low).select(F.col("id").alias("record_id"), "type", "score")


@query("""WITH k AS (SELECT category_id, trim(lower(category_name)) AS w, 8.0 AS weight FROM category_list UNION ALL SELECT category_id, trim(lower(unnest(also_written))), 7.0 FROM category_list
    UNION ALL SELECT category_id, w, greatest(1, len(string_split(w, ' ')))::DOUBLE FROM (SELECT DISTINCT category_id, trim(lower(unnest(core_services))) AS w FROM program_registry JOIN category_list ON category = category_name)),
    p AS (SELECT record_id, lower(concat_ws('. ', program_name, program_category, program_description)) AS low FROM structured_programs), s AS (SELECT record_id, category_id, sum(weight) AS score FROM p JOIN k ON contains(low, w) GROUP BY 1, 2),
    b AS (SELECT record_id, arg_min(category_id, lpad((1000 - score)::BIGINT::VARCHAR, 5, '0') || category_id) AS type, max(score) AS score FROM s GROUP BY 1)
    SELECT record_id, coalesce(type, 'Other') AS type, least(1.0, greatest(0.0, CASE WHEN type IS NULL THEN 0.3 ELSE 0.65 END))::DOUBLE AS confidence FROM p LEFT JOIN b USING (record_id)""")
def prj8_fallback_classified(spark, folder):
    """Eight for a category's name, seven for an example, a keyword's number of words for a keyword."""
    t = Tables(spark, folder)
    own = t.category_list.select(F.col("category_id").alias("type"), F.trim(F.lower("category_name")).alias("word"), F.lit(8.0).alias("weight"))
    words = own.unionByName(t.category_list.select(F.col("category_id").alias("type"), F.explode("also_written").alias("w")).select("type", F.trim(F.lower("w")).alias("word"), F.lit(7.0).alias("weight")))
    services = t.program_registry.join(t.category_list, F.col("category") == F.col("category_name")).select(F.col("category_id").alias("type"), F.explode("core_services").alias("w"))
    services = services.select("type", F.trim(F.lower("w")).alias("word")).distinct().withColumn("weight", F.greatest(F.lit(1), F.size(F.split("word", " "))).cast("double"))
    out = M.classify_by(t.structured_programs, words.unionByName(services), "record_id", F.lower(F.concat_ws(". ", "program_name", "program_category", "program_description")))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("type").isNull(), 0.3).otherwise(0.65)))
    return out.select(F.col("id").alias("record_id"), F.coalesce("type", F.lit("Other")).alias("type"), conf.alias("confidence"))


@query("""SELECT coalesce(c.county_code, d.county_code) AS county_code, coalesce(nullif(d.url, ''), c.url) AS url FROM (SELECT county_code, min(county_website_url) AS url FROM structured_counties GROUP BY 1) c
    FULL JOIN (SELECT county_code, max(county_url) AS url FROM discovery_results GROUP BY 1) d ON c.county_code = d.county_code""")
def jon8_overlay(spark, folder):
    t = Tables(spark, folder)
    base = t.structured_counties.groupBy("county_code").agg(F.min("county_website_url").alias("base"))
    over = t.discovery_results.groupBy("county_code").agg(F.max("county_url").alias("over"))
    return base.join(over, "county_code", "full").select("county_code", F.coalesce(F.nullif("over", F.lit("")), "base").alias("url"))


@query(f"WITH {_MATCH} SELECT program_id FROM program_registry WHERE program_id NOT IN (SELECT program_id FROM m WHERE program_id IS NOT NULL)")
def jon13_absent(spark, folder):
    m = _matched(spark, folder).where("program_id is not null").select("program_id")
    return Tables(spark, folder).program_registry.select("program_id").join(m, "program_id", "left_anti")


@query("""SELECT c.county_code, c.county_code IN (SELECT county_code FROM discovery_results) AS discovered, c.county_code IN (SELECT county_code FROM structured_programs) AS structured FROM (SELECT DISTINCT county_code FROM structured_counties) c""")
def jon14_coverage(spark, folder):
    t = Tables(spark, folder)
    has = lambda df, name: df.select("county_code").distinct().withColumn(name, F.lit(True))
    out = t.structured_counties.select("county_code").distinct().join(has(t.discovery_results, "discovered"), "county_code", "left").join(has(t.structured_programs, "structured"), "county_code", "left")
    return out.fillna(False, ["discovered", "structured"])


@query("SELECT page_id, min(c.county) AS county FROM raw_pages p JOIN (SELECT DISTINCT county FROM raw_pages WHERE trim(county) <> '') c ON contains(lower(text), trim(lower(c.county))) GROUP BY page_id")
def jon19_county_of_text(spark, folder):
    """The first county in alphabetical order that a page's text names."""
    t = spread(Tables(spark, folder).raw_pages.select("page_id", "county", "text"), "page_id")
    names = Tables(spark, folder).raw_pages.where(F.trim("county") != "").select(F.col("county").alias("name")).distinct()
    return M.first_named(t, names, "page_id", F.col("text")).select(F.col("id").alias("page_id"), F.col("name").alias("county"))


_TFIDF = """docs AS (SELECT program_id AS id, lower(concat_ws(' ', canonical_name, acronym, coalesce(target_population, ''), array_to_string(core_services, ' '), array_to_string(county_aliases, ' '))) AS text FROM program_registry),
    dt AS (SELECT id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS term FROM docs), dn AS (SELECT id, count(*) AS n FROM dt GROUP BY id),
    dc AS (SELECT id, term, count(*)::DOUBLE / any_value(n) AS tf FROM dt JOIN dn USING (id) GROUP BY 1, 2), idf AS (SELECT term, ln(((SELECT count(*) FROM docs) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM dc GROUP BY 1),
    dv AS (SELECT id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS norm FROM dc JOIN idf USING (term))"""
_QUERY = """qt AS (SELECT id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS term FROM q), qn AS (SELECT id, count(*) AS n FROM qt GROUP BY id),
    qc AS (SELECT id, term, count(*)::DOUBLE / any_value(n) AS tf FROM qt JOIN qn USING (id) GROUP BY 1, 2), qv AS (SELECT id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS norm FROM qc JOIN idf USING (term)),
    sim AS (SELECT qv.id, dv.id AS doc_id, round(sum(qv.w * dv.w) / (any_value(qv.norm) * any_value(dv.norm)), 6) AS score FROM qv JOIN dv USING (term) GROUP BY 1, 2)"""
_BEST = "best AS (SELECT id, max(score) AS score, min_by(doc_id, (1 - score)::DECIMAL(18, 6)::VARCHAR || doc_id) AS doc FROM sim GROUP BY id)"


@query(f"WITH {_TFIDF} SELECT id AS program_id, term, round(w, 6) AS w FROM dv")
def agg7_registry_vectors(spark, folder):
    """AGG6 to AGG8: document frequencies, shares of terms, weights."""
    v, _ = I.fit(I.corpus(Tables(spark, folder).program_registry))
    return v.select(F.col("id").alias("program_id"), "term", F.round("w", 6).alias("w"))


@query(f"WITH {_TFIDF}, q AS (SELECT record_id AS id, lower(concat_ws(' ', program_name, program_description)) AS text FROM structured_programs), {_QUERY}, {_BEST} SELECT id AS record_id, CASE WHEN score >= 0.2 THEN doc END AS program_id, score FROM best")
def jon12_semantic_match(spark, folder):
    t = Tables(spark, folder)
    v, w = I.fit(I.corpus(t.program_registry))
    q = I.vectors(I.term_counts(t.structured_programs, "record_id", F.concat_ws(" ", "program_name", "program_description"), w), w)
    return I.best_match(q, v).withColumnRenamed("id", "record_id")


_WINDOWS = f"w AS (SELECT doc_id, list_filter(string_split({collapse_sql('lower(text)')}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 60), 30)) AS start FROM w)"


@query(f"WITH {_WINDOWS} SELECT doc_id, start, array_to_string(w[start + 1:start + 60], ' ') AS window FROM s")
def win6_word_windows(spark, folder):
    out = I.word_windows(spread(Tables(spark, folder).documents.select("doc_id", "text").where("text is not null"), "doc_id"), "doc_id", F.col("text"))
    return out.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), "window")


@query(f"""WITH {_TFIDF}, {_WINDOWS}, q AS (SELECT doc_id || '#' || start AS id, array_to_string(w[start + 1:start + 60], ' ') AS text FROM s), {_QUERY},
    k AS (SELECT split_part(id, '#', 1)::BIGINT AS doc_id, split_part(id, '#', 2)::BIGINT AS start, doc_id AS program_id, score FROM sim)
    SELECT doc_id, program_id, min_by(start, (1 - score)::DECIMAL(18, 6)::VARCHAR || lpad(start::VARCHAR, 8, '0')) AS start, max(score) AS score FROM k GROUP BY 1, 2 HAVING max(score) >= 0.2""")
def jon11_window_scan(spark, folder):
    """Documents times programs, each at its best window."""
    t = Tables(spark, folder)
    v, w = I.fit(I.corpus(t.program_registry))
    out = I.scan_windows(spread(t.documents.select("doc_id", "text").where("text is not null"), "doc_id"), t.program_registry.select("program_id"), v, w, "doc_id", F.col("text"), 0.2)
    return out.select(F.col("id").alias("doc_id"), "program_id", F.col("start").cast("long").alias("start"), "score")


_EVENTS = f"""{_MATCH}, {_TFIDF}, q AS (SELECT record_id AS id, lower(concat_ws(' ', program_name, program_description)) AS text FROM structured_programs), {_QUERY}, {_BEST},
    e AS (SELECT p.record_id, p.county_code AS county, p.program_website_url AS url, p.program_name AS name, p.program_description AS sample, list_filter(list_transform(string_split(coalesce(p.required_documentation, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS services, m.program_id, CASE WHEN b.score >= 0.2 THEN b.doc END AS semantic_match, coalesce(b.score, 0.0) AS semantic_score
        FROM structured_programs p JOIN m USING (record_id) LEFT JOIN best b ON b.id = p.record_id WHERE p.program_name IS NOT NULL),
    sg AS (SELECT *, CASE WHEN program_id IS NULL THEN 'unmatched_extraction' WHEN semantic_match IS NOT NULL AND semantic_match <> program_id THEN 'llm_alias_disagreement' ELSE 'matched' END AS signal FROM e)"""


def _events(spark, folder):
    t = Tables(spark, folder)
    v, w = I.fit(I.corpus(t.program_registry))
    best = I.best_match(I.vectors(I.term_counts(t.structured_programs, "record_id", F.concat_ws(" ", "program_name", "program_description"), w), w), v)
    own = t.structured_programs.where("program_name is not null").select(F.col("record_id").alias("id"), F.col("county_code").alias("county"), F.col("program_website_url").alias("url"), F.col("program_name").alias("name"), F.col("program_description").alias("sample"), T.services(F.coalesce("required_documentation", F.lit(""))).alias("services"))
    joined = own.join(_matched(spark, folder).select("id", "program_id"), "id").join(best.select("id", F.col("program_id").alias("semantic_match"), F.col("score").alias("semantic_score")), "id", "left")
    return stage(joined.withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0))).withColumn("ord", F.col("id")), "events")


_GAPS = f"""{_EVENTS}, gp AS (SELECT *, {name_sql('name')} AS norm_name FROM sg WHERE signal <> 'matched'),
    g AS (SELECT norm_name, arg_min(name, record_id) AS extracted_name, count(DISTINCT county) AS n_counties, count(*) AS frequency, max(semantic_score) AS semantic_score, arg_min(sample, record_id) FILTER (WHERE trim(sample) <> '') AS sample_text,
        count(*) FILTER (WHERE signal = 'unmatched_extraction') AS nu, arg_min(signal, record_id) AS first_signal FROM gp GROUP BY 1),
    sm AS (SELECT norm_name, semantic_match FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY semantic_score DESC, record_id) AS rn FROM gp) WHERE rn = 1),
    us AS (SELECT norm_name, string_agg(url, '|' ORDER BY url) AS source_urls FROM (SELECT norm_name, url, row_number() OVER (PARTITION BY norm_name ORDER BY url) AS rn FROM (SELECT DISTINCT norm_name, url FROM gp WHERE url IS NOT NULL)) WHERE rn <= 5 GROUP BY 1),
    se AS (SELECT norm_name, service, min(record_id * 1000 + pos) AS o FROM (SELECT norm_name, record_id, unnest(services) AS service, unnest(range(0, len(services))) AS pos FROM gp) GROUP BY 1, 2),
    sv AS (SELECT norm_name, string_agg(service, '|' ORDER BY o, service) AS services FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY o, service) AS rn FROM se) WHERE rn <= 6 GROUP BY 1),
    gr AS (SELECT norm_name, extracted_name, n_counties, frequency, semantic_match, semantic_score, sample_text, coalesce(source_urls, '') AS source_urls, coalesce(services, '') AS services,
        CASE WHEN nu * 2 = frequency THEN first_signal WHEN nu * 2 > frequency THEN 'unmatched_extraction' ELSE 'llm_alias_disagreement' END AS signal_type,
        CASE WHEN semantic_score >= 0.65 THEN 'likely alias' WHEN semantic_score >= 0.4 THEN 'possible variant' ELSE 'new program' END AS label,
        round(least(n_counties / greatest((SELECT count(DISTINCT county) FROM e), 1)::DOUBLE, 1.0) * 0.4 + least(ln(1.0 + frequency) / ln(21.0), 1.0) * 0.3 + (1.0 - least(semantic_score, 1.0)) * 0.3, 6) AS gap_score
        FROM g JOIN sm USING (norm_name) LEFT JOIN us USING (norm_name) LEFT JOIN sv USING (norm_name))"""


def _gaps(spark, folder):
    return I.gap_candidates(_events(spark, folder)).withColumns({"source_urls": F.array_join("source_urls", "|"), "services": F.array_join("services", "|")})


@query(f"WITH {_GAPS} SELECT * FROM gr")
def evl11_gap_report(spark, folder):
    """AGG9, AGG10 and PRJ16: candidates for new programs, scored, with all that is known of them."""
    return _gaps(spark, folder)


@query(f"WITH {_GAPS} SELECT * FROM (SELECT row_number() OVER (ORDER BY gap_score DESC, norm_name) AS rank, norm_name, extracted_name, signal_type, label, gap_score FROM gr) WHERE rank <= 10")
def top2_gap_candidates(spark, folder):
    """TOP2: the ten candidates with the greatest scores."""
    top = _gaps(spark, folder).select("norm_name", "extracted_name", "signal_type", "label", "gap_score").orderBy(F.col("gap_score").desc(), "norm_name").limit(10)
    rows = top.groupBy().agg(F.array_sort(F.collect_list(F.struct(-F.col("gap_score"), "norm_name", "extracted_name", "signal_type", "label", "gap_score"))).alias("r"))
    return rows.select(F.posexplode("r").alias("pos", "r")).select((F.col("pos") + 1).cast("long").alias("rank"), "r.norm_name", "r.extracted_name", "r.signal_type", "r.label", "r.gap_score")


@query(f"WITH {_EVENTS} SELECT count(DISTINCT county) AS counties, count(*) AS extractions, count(*) FILTER (WHERE signal = 'matched') AS matched, round(count(*) FILTER (WHERE signal <> 'matched') / count(*)::DOUBLE, 6) AS unmatched_rate FROM sg")
def agg4_match_rate(spark, folder):
    e = _events(spark, folder)
    signal = F.col("program_id").isNotNull() & ~F.coalesce(F.col("semantic_match") != F.col("program_id"), F.lit(False))
    return e.agg(F.countDistinct("county").alias("counties"), F.count("*").alias("extractions"), F.count_if(signal).alias("matched"), F.round(F.count_if(~signal) / F.count("*"), 6).alias("unmatched_rate"))


@query(f"WITH {_EVENTS} SELECT semantic_match AS program_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM sg WHERE signal <> 'matched' AND semantic_match IS NOT NULL AND semantic_score >= 0.65 GROUP BY 1")
def agg12_alias_suggestions(spark, folder):
    e = _events(spark, folder).where("(program_id is null or semantic_match <> program_id) and semantic_match is not null and semantic_score >= 0.65")
    return e.groupBy(F.col("semantic_match").alias("program_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


_PAGE_WINDOWS = f"pw AS (SELECT page_id, list_filter(string_split({collapse_sql('lower(text)')}, ' '), lambda x: x <> '') AS w FROM raw_pages WHERE text IS NOT NULL), ps AS (SELECT page_id, w, unnest(range(0, greatest(1, len(w) - 60), 30)) AS start FROM pw)"
_ABSENT = f"""{_MATCH}, ab AS (SELECT program_id FROM program_registry WHERE program_id NOT IN (SELECT program_id FROM m JOIN structured_programs USING (record_id) WHERE confidence = 1 AND source_system = 'phase2_enhanced' AND data_version = 'v5' AND program_id IS NOT NULL)),
    {_TFIDF}, {_PAGE_WINDOWS}, q AS (SELECT page_id || '#' || start AS id, array_to_string(w[start + 1:start + 60], ' ') AS text FROM ps), {_QUERY},
    sc AS (SELECT split_part(id, '#', 1)::BIGINT AS page_id, doc_id AS program_id, max(score) AS score FROM sim WHERE doc_id IN (SELECT program_id FROM ab) GROUP BY 1, 2 HAVING max(score) >= 0.2)"""


def _absence_signals(spark, folder):
    """JON11, JON13: pages that read like a program which the last version of one source never names by an alias."""
    t = Tables(spark, folder)
    sure = _matched(spark, folder).where("confidence = 1 and program_id is not null").select(F.col("id").alias("record_id"), "program_id")
    named = t.structured_programs.where("source_system = 'phase2_enhanced' and data_version = 'v5'").select("record_id").join(sure, "record_id").select("program_id")
    absent = t.program_registry.select("program_id").join(named, "program_id", "left_anti")
    v, w = I.fit(I.corpus(t.program_registry))
    return I.scan_windows(spread(t.raw_pages.select("page_id", "text").where("text is not null"), "page_id"), absent, v, w, "page_id", F.col("text"), 0.2).select(F.col("id").alias("page_id"), "program_id", "score")


@query(f"WITH {_ABSENT} SELECT page_id, program_id, score FROM sc")
def jon11_absent_programs(spark, folder):
    """JON11: windows of pages scanned for the absent programs only."""
    return _absence_signals(spark, folder)


@query(f"WITH {_ABSENT} SELECT program_id, pages, counties FROM (SELECT *, row_number() OVER (ORDER BY pages DESC, program_id) AS rn FROM (SELECT program_id, count(*) AS pages, count(DISTINCT county) AS counties FROM sc JOIN raw_pages USING (page_id) GROUP BY 1)) WHERE rn <= 5")
def agg11_absence_by_program(spark, folder):
    """AGG11: the five absent programs with most pages that read like them."""
    pages = Tables(spark, folder).raw_pages.select("page_id", "county")
    return _absence_signals(spark, folder).join(pages, "page_id").groupBy("program_id").agg(F.count("*").alias("pages"), F.countDistinct("county").alias("counties")).orderBy(F.col("pages").desc(), "program_id").limit(5)
