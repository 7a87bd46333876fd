"""Scans, gates and projections over pages, links and programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators.collections import collection_name, county_of_collection, recursive_chunks, run_states
from millrace.operators.links import county_domain
from millrace.operators.terms import held_terms
from millrace.runtime import spread
from millrace.plans.base import ALIAS_SQL, KEYWORD_SQL, Tables, collapse_sql, host_sql, name_sql, parts_sql, path_sql, query, sql_list
from millrace.sources.files import latest_version
from millrace.sources.sinks import page_key, publish_rows

_URL_KEY = r"regexp_replace(regexp_replace(lower({c}), '[?#].*$', ''), '/+$', '')"


@query("SELECT county, count(*) AS pages, count(text) AS with_text, count(DISTINCT page_url) AS urls FROM raw_pages GROUP BY county")
def src1_raw_pages(spark, folder):
    t = Tables(spark, folder).raw_pages
    return t.groupBy("county").agg(F.count("*").alias("pages"), F.count("text").alias("with_text"), F.countDistinct("page_url").alias("urls"))


@query("SELECT page_id, contacts IS NOT NULL AND county IS NOT NULL AND page_url IS NOT NULL AND scraped_at IS NOT NULL AS valid FROM raw_pages")
def src2_validated_pages(spark, folder):
    c = [F.col(x).isNotNull() for x in ("contacts", "county", "page_url", "scraped_at")]
    return Tables(spark, folder).raw_pages.select("page_id", (c[0] & c[1] & c[2] & c[3]).alias("valid"))


@query("SELECT page_id, county, text FROM raw_pages WHERE trim(text) <> ''")
def src3_raw_texts(spark, folder):
    return Tables(spark, folder).raw_pages.where(F.trim("text") != "").select("page_id", "county", "text")


@query("SELECT page_id, coalesce(nullif(trim(county), ''), split_part(regexp_replace(page_url, '^[a-z]+://', ''), '/', 1)) AS county, coalesce(nullif(page_url, ''), nullif(nav_path, '')) AS url FROM raw_pages")
def src4_fallback_keys(spark, folder):
    t = Tables(spark, folder).raw_pages
    host = F.split_part(F.regexp_replace("page_url", "^[a-z]+://", ""), F.lit("/"), F.lit(1))
    return t.select("page_id", F.coalesce(F.nullif(F.trim("county"), F.lit("")), host).alias("county"), F.coalesce(F.nullif("page_url", F.lit("")), F.nullif("nav_path", F.lit(""))).alias("url"))


@query("SELECT data_version, min(county_name) AS first_county, count(*) AS n FROM structured_programs WHERE trim(program_name) <> '' GROUP BY data_version")
def src5_programs_by_version(spark, folder):
    t = Tables(spark, folder).structured_programs.where(F.trim("program_name") != "")
    return t.groupBy("data_version").agg(F.min("county_name").alias("first_county"), F.count("*").alias("n"))


@query("SELECT record_id, program_name FROM structured_programs WHERE TRY_CAST(regexp_extract(data_version, '^v(\\d+)$', 1) AS INT) = (SELECT max(TRY_CAST(regexp_extract(data_version, '^v(\\d+)$', 1) AS INT)) FROM structured_programs) AND lower(trim(program_name)) NOT IN ('not found', 'n/a', '')")
def src7_latest_programs(spark, folder):
    t = latest_version(Tables(spark, folder).structured_programs, "data_version")
    return t.where(~F.lower(F.trim("program_name")).isin("not found", "n/a", "")).select("record_id", "program_name")


@query("""SELECT county_code, count(*) AS n, arg_max(health_department_name, record_id) AS department FROM structured_counties WHERE health_department_name IS NOT NULL GROUP BY county_code""")
def src8_last_department(spark, folder):
    t = Tables(spark, folder).structured_counties.where("health_department_name is not null")
    return t.groupBy("county_code").agg(F.count("*").alias("n"), F.max_by("health_department_name", "record_id").alias("department"))


@query("SELECT result_id, county_code, unnest(programs).name AS name, unnest(programs).url AS url, unnest(programs).score AS score, unnest(range(1, len(programs) + 1)) AS rank FROM discovery_results")
def src9_discovery_links(spark, folder):
    t = Tables(spark, folder).discovery_results.select("result_id", "county_code", F.posexplode("programs").alias("pos", "p"))
    return t.select("result_id", "county_code", "p.name", "p.url", "p.score", (F.col("pos") + 1).cast("long").alias("rank"))


@query("SELECT max(TRY_CAST(regexp_extract(data_version, '^v(\\d+)$', 1) AS INT)) AS latest, max(TRY_CAST(regexp_extract(data_version, '^v(\\d+)$', 1) AS INT)) + 1 AS next FROM structured_programs")
def src12_versions(spark, folder):
    v = F.regexp_extract("data_version", r"^v(\d+)$", 1).try_cast("int")
    return Tables(spark, folder).structured_programs.agg(F.max(v).alias("latest"), (F.max(v) + 1).alias("next"))


@query("""SELECT p.county_code, p.program_uid, coalesce(o.application_process, p.application_process) AS application_process
    FROM (SELECT county_code, program_uid, arg_min(application_process, record_id) AS application_process FROM structured_programs WHERE application_process IS NOT NULL GROUP BY 1, 2) p
    LEFT JOIN (SELECT program_uid, arg_min(application_process, record_id) AS application_process FROM structured_programs WHERE application_process IS NOT NULL AND source_system = 'manual_override' GROUP BY 1) o USING (program_uid)""")
def src17_override(spark, folder):
    t = Tables(spark, folder).structured_programs.where("application_process is not null")
    base = t.groupBy("county_code", "program_uid").agg(F.min_by("application_process", "record_id").alias("a"))
    over = t.where("source_system = 'manual_override'").groupBy("program_uid").agg(F.min_by("application_process", "record_id").alias("o"))
    return base.join(over, "program_uid", "left").select("county_code", "program_uid", F.coalesce("o", "a").alias("application_process"))


@query("""SELECT page_id, slug || '-' || substr(sha1(page_url), 1, 10) AS key FROM (SELECT page_id, page_url, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(program_name_guess), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'item') AS slug FROM raw_pages)""")
def snk1_page_keys(spark, folder):
    return Tables(spark, folder).raw_pages.select("page_id", page_key(F.col("program_name_guess"), F.col("page_url")).alias("key"))


@query("""SELECT c.county_name AS "County_Name", coalesce(nullif(trim(p.program_name), ''), 'Not found') AS "Program_Name", coalesce(nullif(trim(p.program_category), ''), 'Other') AS "Program_Category", coalesce(nullif(trim(c.health_department_contact_email), ''), 'Not found') AS "Health_Department_Contact_Email"
    FROM (SELECT * FROM structured_counties WHERE record_id IN (SELECT min(record_id) FROM structured_counties GROUP BY county_code)) c LEFT JOIN structured_programs p USING (county_code)""")
def snk2_published(spark, folder):
    t = Tables(spark, folder)
    first = t.structured_counties.groupBy("county_code").agg(F.min("record_id").alias("record_id"))
    counties = t.structured_counties.join(first.select("record_id"), "record_id", "left_semi").select("county_code", "county_name", "county_website_url", "health_department_name", "health_department_contact_email", "health_department_contact_phone")
    programs = t.structured_programs.select("county_code", "program_name", "program_category", "program_description", "target_population", "eligibility_requirements", "application_process", "required_documentation", "financial_assistance_available", "program_website_url", "notes")
    return publish_rows(counties, programs, "2026-01-01").select("County_Name", "Program_Name", "Program_Category", "Health_Department_Contact_Email")


_LINKS = "(SELECT result_id, unnest(range(1, len(programs) + 1)) AS rank, unnest(programs).url AS url, unnest(programs).link_text AS link_text, coalesce(county_url, '') AS base FROM discovery_results)"


def _links(spark, folder):
    t = Tables(spark, folder).discovery_results.select("result_id", F.coalesce("county_url", F.lit("")).alias("base"), F.posexplode("programs").alias("pos", "p"))
    return t.select("result_id", (F.col("pos") + 1).cast("long").alias("rank"), "p.url", "p.link_text", "base")


@query(f"""WITH {ALIAS_SQL}, l AS (SELECT *, trim(lower(coalesce(link_text, ''))) AS t, {path_sql('url')} AS path, {parts_sql('url')} AS parts FROM {_LINKS})
    SELECT result_id, rank, reason, reason NOT IN ('invalid url', 'generic link text', 'link text too short', 'bad url segment') AS keep FROM (SELECT result_id, rank, CASE
    WHEN coalesce(NOT starts_with(lower(url), 'http'), true) THEN 'invalid url' WHEN list_contains({sql_list(G.GENERIC_TEXTS)}, t) THEN 'generic link text' WHEN length(t) < 3 THEN 'link text too short'
    WHEN list_has_any(parts, {sql_list(G.BAD_SEGMENTS)}) THEN 'bad url segment' WHEN list_has_any(parts, {sql_list(G.GOOD_SEGMENTS)}) THEN 'good url segment'
    WHEN EXISTS (SELECT 1 FROM alias WHERE contains(t, alias)) THEN 'alias in link text'
    WHEN EXISTS (SELECT 1 FROM alias WHERE contains(path, replace(alias, ' ', '-')) OR contains(path, replace(alias, ' ', '_'))) THEN 'alias in url path'
    WHEN len(list_filter(string_split({collapse_sql('t')}, ' '), lambda w: w <> '')) >= 4 THEN 'substantive link text' ELSE 'low confidence' END AS reason FROM l)""")
def prd1_url_gate(spark, folder):
    aliases = Tables(spark, folder).aliases()
    in_path = aliases.select(F.explode(F.array(*[F.replace("alias", F.lit(" "), F.lit(x)) for x in "-_"])).alias("a"))
    links = held_terms(_links(spark, folder), F.trim(F.lower(F.coalesce("link_text", F.lit("")))), aliases, "in_text")
    g = G.url_gate(F.col("url"), F.col("link_text"), (F.col("in_text"), F.col("in_path")))
    return held_terms(links, T.url_path(F.col("url")), in_path, "in_path").select("result_id", "rank", g.alias("g")).select("result_id", "rank", "g.keep", "g.reason")


_SCORE = "(SELECT count(*) FROM alias WHERE contains(low, alias)) + CASE WHEN len(list_filter({ind}, lambda w: contains(low, w))) >= 3 THEN 1 ELSE 0 END"


@query(f"WITH {ALIAS_SQL}, p AS (SELECT page_id, lower(coalesce(text, '')) AS low FROM raw_pages) SELECT page_id, {_SCORE.format(ind=sql_list(G.INDICATORS))} AS score FROM p")
def prd2_content_score(spark, folder):
    t = Tables(spark, folder)
    low = spread(t.raw_pages.select("page_id", "text"), "page_id").select("page_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return held_terms(low, F.col("low"), t.aliases()).select("page_id", G.content_score(F.col("low"), F.col("held")).cast("long").alias("score"))


@query(f"WITH {ALIAS_SQL}, p AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, {_SCORE.format(ind=sql_list(G.FEWER_INDICATORS))} AS score FROM p")
def prd3_document_score(spark, folder):
    t = Tables(spark, folder)
    low = spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return held_terms(low, F.col("low"), t.aliases()).select("doc_id", G.content_score(F.col("low"), F.col("held"), G.FEWER_INDICATORS).cast("long").alias("score"))


@query(f"""WITH {ALIAS_SQL}, p AS (SELECT page_id, lower(coalesce(text, '')) AS low FROM raw_pages), s AS (SELECT page_id, low, CASE WHEN length(low) >= 200 THEN {_SCORE.format(ind=sql_list(G.INDICATORS))} ELSE 0 END AS score FROM p)
    SELECT page_id, score, CASE WHEN length(low) < 200 THEN 'page too short' WHEN score < 1 THEN 'no registry signal' ELSE 'program page' END AS reason FROM s""")
def prd4_program_pages(spark, folder):
    t = Tables(spark, folder)
    return G.page_gate(spread(t.raw_pages.select("page_id", "text"), "page_id"), t.aliases()).select("page_id", F.col("score").cast("long").alias("score"), "reason")


_EXCLUDED = ["parks", "elections", "animal", "permit", "transit", "library"]


@query(f"""WITH {ALIAS_SQL}, {KEYWORD_SQL}, l AS (SELECT *, lower(coalesce(link_text, '') || ' ' || coalesce(url, '')) AS b, trim(lower(coalesce(link_text, ''))) AS t, {parts_sql("coalesce(url, '')")} AS parts FROM {_LINKS}),
    k AS (SELECT *, (SELECT count(*) FROM keyword WHERE contains(b, word)) AS hits FROM l)
    SELECT result_id, rank, round(CASE WHEN list_has_any(parts, {sql_list(G.BAD_SEGMENTS)}) OR t = '' OR list_contains({sql_list(G.GENERIC_TEXTS)}, t) THEN 0 ELSE
    CASE WHEN EXISTS (SELECT 1 FROM alias WHERE contains(b, alias)) THEN 3.0 ELSE 0 END + CASE WHEN hits > 0 THEN 2.0 + least(1.0, hits / 5.0) ELSE 0 END
    - CASE WHEN len(list_filter({sql_list(G.SOCIAL_HOSTS)}, lambda h: contains(coalesce(url, ''), h))) > 0 THEN 5.0 ELSE 0 END
    - CASE WHEN len(list_filter({sql_list(_EXCLUDED)}, lambda h: contains(b, h))) > 0 AND hits = 0 THEN 3.0 ELSE 0 END END::DOUBLE, 6) AS score FROM k""")
def prd5_link_score(spark, folder):
    t = Tables(spark, folder)
    s = G.link_score(F.col("url"), F.col("link_text"), F.col("aliases"), F.col("words"), _EXCLUDED)
    both = F.lower(F.concat_ws(" ", F.coalesce("link_text", F.lit("")), F.coalesce("url", F.lit(""))))
    return held_terms(held_terms(_links(spark, folder), both, t.aliases(), "aliases"), both, t.keywords(), "words").select("result_id", "rank", F.round(s, 6).alias("score"))


@query(f"SELECT result_id, rank, len(list_filter({sql_list(G.BASIC_KEYWORDS)}, lambda k: contains(lower(coalesce(link_text, '') || ' ' || coalesce(url, '')), k))) > 0 AS hit FROM {_LINKS}")
def prd6_basic_hit(spark, folder):
    both = F.lower(F.concat_ws(" ", F.coalesce("link_text", F.lit("")), F.coalesce("url", F.lit(""))))
    return _links(spark, folder).select("result_id", "rank", T.holds_any(both, G.BASIC_KEYWORDS).alias("hit"))


@query(f"SELECT result_id, rank, {host_sql('url')} = {host_sql('base')} OR ends_with({host_sql('url')}, '.' || {host_sql('base')}) AS same FROM {_LINKS}")
def prd7_same_domain(spark, folder):
    return _links(spark, folder).select("result_id", "rank", T.same_domain(F.col("base"), F.col("url")).alias("same"))


@query(f"""WITH {KEYWORD_SQL}, p AS (SELECT record_id, lower(concat_ws(' ', program_name, program_description)) AS low FROM structured_programs), h AS (SELECT *, (SELECT count(*) FROM keyword WHERE contains(low, word)) AS hits FROM p)
    SELECT record_id, hits > 0 AS maternal, hits = 0 AND len(list_filter({sql_list(_EXCLUDED)}, lambda h: contains(low, h))) > 0 AS non_maternal, round(least(1.0, hits / 5.0)::DOUBLE, 6) AS relevance FROM h""")
def prd8_topic_flags(spark, folder):
    t = Tables(spark, folder)
    low = t.structured_programs.select("record_id", F.lower(F.concat_ws(" ", "program_name", "program_description")).alias("low"))
    words = F.col("held")
    topic = T.holds_any(F.col("low"), words)
    return held_terms(low, F.col("low"), t.keywords()).select("record_id", topic.alias("maternal"), (~topic & T.holds_any(F.col("low"), _EXCLUDED)).alias("non_maternal"), F.round(G.relevance(F.col("low"), words), 6).alias("relevance"))


@query("SELECT record_id, coalesce(trim(lower(eligibility_requirements)) NOT IN ('not found', 'not specified', '', 'none', 'n/a'), false) AS filled FROM structured_programs")
def prd10_filled(spark, folder):
    return Tables(spark, folder).structured_programs.select("record_id", G.is_filled(F.col("eligibility_requirements")).alias("filled"))


@query("""SELECT county_code, round(avg(CASE WHEN coalesce(eligibility_requirements IN ('Not specified', 'Not found', ''), true) OR coalesce(application_process IN ('Not specified', 'Not found', ''), true) THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM structured_programs GROUP BY county_code""")
def prd11_critical_missing(spark, folder):
    missing = G.is_critical_missing(F.col("eligibility_requirements")) | G.is_critical_missing(F.col("application_process"))
    return Tables(spark, folder).structured_programs.groupBy("county_code").agg(F.round(F.avg(missing.cast("double")), 6).alias("missing_rate"))


@query("SELECT record_id, lower(trim(program_name)) NOT IN ('not found', 'n/a', '') AS show_name, lower(trim(program_description)) NOT IN ('not specified', 'not found', '') AS show_body FROM structured_programs")
def prd12_displayable(spark, folder):
    show = lambda c, xs: ~F.lower(F.trim(c)).isin(*xs)
    return Tables(spark, folder).structured_programs.select("record_id", show("program_name", ["not found", "n/a", ""]).alias("show_name"), show("program_description", ["not specified", "not found", ""]).alias("show_body"))


@query("SELECT page_id, contains(lower(text), '$(serve_403)') OR contains(lower(text), 'reference #18.') AS refused FROM raw_pages WHERE text IS NOT NULL")
def prd13_refused_pages(spark, folder):
    """The two markers of a firewall anywhere."""
    return Tables(spark, folder).raw_pages.where("text is not null").select("page_id", G.is_refused(F.col("text")).alias("refused"))


@query("SELECT page_id, len(list_filter(['just a moment', 'checking your browser', 'not a robot', 'access denied', 'attention required'], lambda w: contains(lower(substr(coalesce(text, ''), 1, 500)), w))) > 0 AS challenge FROM raw_pages")
def prd13_challenge_pages(spark, folder):
    return Tables(spark, folder).raw_pages.select("page_id", G.is_challenge_page(F.col("text")).alias("challenge"))


@query(f"SELECT page_id, link, regexp_matches(lower(link), '\\.pdf$|/pdf') AS strict, contains(lower(link), 'pdf') AS loose, regexp_matches({host_sql('link')}, '\\.(gov|us)$') AS gov FROM (SELECT page_id, unnest(pdf_links) AS link FROM raw_pages)")
def prd14_pdf_links(spark, folder):
    t = Tables(spark, folder).raw_pages.select("page_id", F.explode("pdf_links").alias("link"))
    return t.select("page_id", "link", G.is_pdf_link(F.col("link")).alias("strict"), G.is_pdf_link(F.col("link"), anywhere=True).alias("loose"), G.is_gov(F.col("link")).alias("gov"))


@query(f"""WITH {ALIAS_SQL} SELECT result_id, rank FROM {_LINKS} WHERE {host_sql('url')} = {host_sql('base')} AND NOT list_has_any({parts_sql('url')}, {sql_list(G.BAD_SEGMENTS)})
    AND (list_has_any({parts_sql('url')}, {sql_list(G.GOOD_SEGMENTS)}) OR EXISTS (SELECT 1 FROM alias WHERE contains(lower(coalesce(link_text, '')), alias)))""")
def prd17_sub_links(spark, folder):
    parts, lits = T.path_parts(F.col("url")), lambda xs: F.array(*map(F.lit, xs))
    text = F.lower(F.coalesce("link_text", F.lit("")))
    good = F.arrays_overlap(parts, lits(G.GOOD_SEGMENTS)) | T.holds_any(text, F.col("held"))
    own = _links(spark, folder).where((T.url_host(F.col("url")) == T.url_host(F.col("base"))) & ~F.arrays_overlap(parts, lits(G.BAD_SEGMENTS)))
    return held_terms(own, text, Tables(spark, folder).aliases()).where(good).select("result_id", "rank")


_CLASS_SQL = f"""(SELECT count(*) FROM keyword WHERE contains(low, word)) * 2.0 + CASE WHEN len(list_filter({sql_list([*G.ELIGIBILITY_WORDS, 'who can'])}, lambda w: contains(low, w))) > 0 THEN 3.0 ELSE 0.0 END
    + CASE WHEN len(list_filter({sql_list([*G.APPLY_WORDS, 'register'])}, lambda w: contains(low, w))) > 0 THEN 3.0 ELSE 0.0 END"""


@query(f"WITH {KEYWORD_SQL}, p AS (SELECT page_id, lower(coalesce(text, '')) AS low FROM raw_pages), s AS (SELECT page_id, ({_CLASS_SQL})::DOUBLE AS score FROM p) SELECT page_id, score, score >= 5 AS is_program FROM s")
def prd18_classify_pages(spark, folder):
    t = Tables(spark, folder)
    low = spread(t.raw_pages.select("page_id", "text"), "page_id").select("page_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return held_terms(low, F.col("low"), t.keywords()).select("page_id", G.page_class_score(F.col("low"), F.col("held")).alias("score")).withColumn("is_program", F.col("score") >= 5)


@query(f"""WITH p AS (SELECT page_id, lower(coalesce(text, '')) AS low, coalesce(len(contacts.phones), 0) + coalesce(len(contacts.emails), 0) > 0 AS has FROM raw_pages),
    m AS (SELECT page_id, list_filter([CASE WHEN len(list_filter({sql_list(G.ELIGIBILITY_WORDS)}, lambda w: contains(low, w))) = 0 THEN 'eligibility' END, CASE WHEN len(list_filter({sql_list(G.APPLY_WORDS)}, lambda w: contains(low, w))) = 0 THEN 'apply' END, CASE WHEN NOT has THEN 'contact' END], lambda x: x IS NOT NULL) AS m FROM p)
    SELECT page_id, array_to_string(m, ',') AS missing, len(m) <= 1 AS verified FROM m""")
def prd19_verify(spark, folder):
    t = Tables(spark, folder).raw_pages
    has = (F.coalesce(F.size("contacts.phones"), F.lit(0)) > 0) | (F.coalesce(F.size("contacts.emails"), F.lit(0)) > 0)
    low = t.select("page_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), has.alias("has"))
    m = low.select("page_id", G.missing_signals(F.col("low"), F.col("has")).alias("m"))
    return m.select("page_id", F.array_join("m", ",").alias("missing"), (F.size("m") <= 1).alias("verified"))


_TIERS = [(["health", "department"], 2.0), (["birth", "infant", "newborn"], 3.0), (["program", "clinic", "support"], 5.0)]


@query(f"""SELECT result_id, rank, round(greatest(0, {' + '.join(f"CASE WHEN len(list_filter({sql_list(ws)}, lambda w: contains(lower(coalesce(link_text, '') || ' ' || coalesce(url, '')), w))) > 0 THEN {x} ELSE 0 END" for ws, x in _TIERS)}
    - CASE WHEN {host_sql('url')} <> '' AND {host_sql('url')} <> {host_sql('base')} THEN 2.0 ELSE 0 END)::DOUBLE, 6) AS score FROM {_LINKS} WHERE url IS NOT NULL""")
def prd20_tiered_score(spark, folder):
    return _links(spark, folder).where("url is not null").select("result_id", "rank", F.round(G.tiered_link_score(F.col("url"), F.col("link_text"), F.col("base"), _TIERS), 6).alias("score"))


@query(f"SELECT page_id, regexp_matches(list_extract(string_split(regexp_replace({path_sql('page_url')}, '/+$', ''), '/'), -1), '^[a-z]{{4,}}$') AND list_extract(string_split(regexp_replace({path_sql('page_url')}, '/+$', ''), '/'), -1) NOT IN (SELECT unnest({sql_list(G.PLAIN_SLUGS)})) AS plain FROM raw_pages")
def prd21_plain_slugs(spark, folder):
    return Tables(spark, folder).raw_pages.select("page_id", G.is_plain_slug(F.col("page_url")).alias("plain"))


@query("""SELECT record_id, CASE WHEN trim(coalesce(program_category, '')) = '' THEN 'Other' ELSE program_category END AS category,
    CASE WHEN lower(trim(eligibility_requirements)) = 'not specified' THEN 'Not specified' ELSE eligibility_requirements END AS eligibility, coalesce(financial_assistance_available IN ('Yes', 'No', 'Unknown'), false) AS valid FROM structured_programs""")
def prd22_validated_programs(spark, folder):
    t = Tables(spark, folder).structured_programs
    return t.select(
        "record_id", F.when(F.trim(F.coalesce("program_category", F.lit(""))) == "", "Other").otherwise(F.col("program_category")).alias("category"),
        F.when(F.lower(F.trim("eligibility_requirements")) == "not specified", "Not specified").otherwise(F.col("eligibility_requirements")).alias("eligibility"), F.coalesce(F.col("financial_assistance_available").isin("Yes", "No", "Unknown"), F.lit(False)).alias("valid"),
    )


@query("""WITH g AS (SELECT county, count(*) AS files, sum(length(coalesce(text, '')))::BIGINT // count(*) AS avg_chars, count(*) FILTER (WHERE length(coalesce(text, '')) < 100) AS bad FROM raw_pages WHERE county IS NOT NULL GROUP BY county)
    SELECT county, files, avg_chars, bad, CASE WHEN files = 1 AND bad = 1 THEN 'only one file' WHEN bad = files THEN 'all files short' WHEN avg_chars < 200 THEN 'thin' ELSE 'good' END AS bucket FROM g""")
def prd23_quality(spark, folder):
    n = F.length(F.coalesce("text", F.lit("")))
    g = Tables(spark, folder).raw_pages.where("county is not null").groupBy("county").agg(F.count("*").alias("files"), F.sum(n).alias("chars"), F.count_if(n < 100).alias("bad"))
    bucket = F.when((F.col("files") == 1) & (F.col("bad") == 1), "only one file").when(F.col("bad") == F.col("files"), "all files short").when(F.col("avg_chars") < 200, "thin").otherwise("good")
    return g.withColumn("avg_chars", F.expr("chars div files")).select("county", "files", "avg_chars", "bad", bucket.alias("bucket"))


@query("SELECT program_id, tier, coalesce(state_specific, 'all') AS state FROM program_registry WHERE state_specific IS NULL OR state_specific = 'CA'")
def prd24_applicable(spark, folder):
    t = Tables(spark, folder).program_registry.where("state_specific is null or state_specific = 'CA'")
    return t.select("program_id", "tier", F.coalesce("state_specific", F.lit("all")).alias("state"))


@query("SELECT program_id, tier = 1 AS first_tier, category = 'Food & Nutrition Aid' AS food, blueprint_goal = 3 AS goal, federal_agency LIKE 'Office%' AS office, federal_source_url IS NOT NULL AS federal FROM program_registry WHERE tier IN (1, 2)")
def prd24_filters(spark, folder):
    """Filters of a registry by tier, category, goal, agency and source."""
    t = Tables(spark, folder).program_registry.where(F.col("tier").isin(1, 2))
    return t.select("program_id", (F.col("tier") == 1).alias("first_tier"), (F.col("category") == "Food & Nutrition Aid").alias("food"), (F.col("blueprint_goal") == 3).alias("goal"), F.col("federal_agency").startswith("Office").alias("office"), F.col("federal_source_url").isNotNull().alias("federal"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 80")
def prd25_long_enough(spark, folder):
    return Tables(spark, folder).documents.where(F.length(F.trim("text")) >= 80).select("doc_id")


# Functions.
@query(f"SELECT record_id, {name_sql('program_name')} AS name FROM structured_programs")
def fn_normalize_name(spark, folder):
    return Tables(spark, folder).structured_programs.select("record_id", T.normalize_name(F.col("program_name")).alias("name"))


@query(f"SELECT doc_id, sha1(lower({collapse_sql('substr(text, 1, 2000)')})) AS fingerprint FROM documents")
def fn_fingerprint(spark, folder):
    return Tables(spark, folder).documents.select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\(?[0-9]{3}\)?[-. \t\n\r\f\v]?[0-9]{3}[-. \t\n\r\f\v]?[0-9]{4}'))), '|') AS phones,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))), '|') AS emails FROM documents WHERE text IS NOT NULL""")
def fn_contacts(spark, folder):
    t = spread(Tables(spark, folder).documents.select("doc_id", "text").where("text is not null"), "doc_id")
    return t.select("doc_id", F.array_join(T.phones(F.col("text")), "|").alias("phones"), F.array_join(T.emails(F.col("text")), "|").alias("emails"))


@query(f"SELECT page_id, {_URL_KEY.format(c='page_url')} AS url, {host_sql('page_url')} AS host, translate(contacts.phones[1], '-() ', '') AS phone FROM raw_pages")
def fn_keys(spark, folder):
    return Tables(spark, folder).raw_pages.select("page_id", T.url_key(F.col("page_url")).alias("url"), T.url_host(F.col("page_url")).alias("host"), T.phone_key(F.get("contacts.phones", F.lit(0))).alias("phone"))


@query("SELECT county_code, 'county_' || replace(lower(trim(county_name)), ' ', '_') AS collection FROM structured_counties WHERE county_name IS NOT NULL")
def fn_collections(spark, folder):
    t = Tables(spark, folder).structured_counties.where("county_name is not null")
    return t.select("county_code", F.concat(F.lit("county_"), F.replace(F.lower(F.trim("county_name")), F.lit(" "), F.lit("_"))).alias("collection"))


@query("SELECT program_id, array_to_string(list_filter(list_transform(string_split(array_to_string(core_services, ' ; '), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS services FROM program_registry")
def fn_services(spark, folder):
    return Tables(spark, folder).program_registry.select("program_id", F.array_join(T.services(F.array_join("core_services", " ; ")), "|").alias("services"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def fn_json(spark, folder):
    return Tables(spark, folder).events.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


# Projections of records.
@query("""SELECT page_id, substr(coalesce(link_text, ''), 1, 200) AS link_text, array_to_string(coalesce(contacts.phones, []), '; ') AS phones, array_to_string(coalesce(contacts.emails, []), '; ') AS emails, array_to_string(coalesce(pdf_links, []), '; ') AS pdfs FROM raw_pages WHERE length(trim(text)) >= 80""")
def prj11_chunk_records(spark, folder):
    t = Tables(spark, folder).raw_pages.where(F.length(F.trim("text")) >= 80)
    return t.select("page_id", F.substring(F.coalesce("link_text", F.lit("")), 1, 200).alias("link_text"), F.concat_ws("; ", "contacts.phones").alias("phones"), F.concat_ws("; ", "contacts.emails").alias("emails"), F.concat_ws("; ", "pdf_links").alias("pdfs"))


@query("SELECT page_id, 'County: ' || coalesce(county, 'Unknown') || chr(10) || 'URL: ' || page_url || chr(10) || 'PDF: ' || array_to_string(coalesce(pdf_links, [])[1:8], ', ') || chr(10) || substr(coalesce(text, ''), 1, 10000) AS prompt FROM raw_pages")
def prj12_prompts(spark, folder):
    c = F.concat(F.lit("County: "), F.coalesce("county", F.lit("Unknown")), F.lit("\nURL: "), F.col("page_url"), F.lit("\nPDF: "), F.concat_ws(", ", F.slice("pdf_links", 1, 8)), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 10000))
    return Tables(spark, folder).raw_pages.select("page_id", c.alias("prompt"))


@query("SELECT tier, string_agg(program_id || ': ' || canonical_name || ' (' || array_to_string(county_aliases[1:4], ', ') || ') ' || substr(coalesce(target_population, ''), 1, 80), chr(10) ORDER BY program_id) AS block FROM program_registry GROUP BY tier")
def prj13_registry_text(spark, folder):
    line = F.concat(F.col("program_id"), F.lit(": "), F.col("canonical_name"), F.lit(" ("), F.array_join(F.slice("county_aliases", 1, 4), ", "), F.lit(") "), F.substring(F.coalesce("target_population", F.lit("")), 1, 80))
    own = Tables(spark, folder).program_registry.select("tier", "program_id", line.alias("line"))
    return own.groupBy("tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("program_id", "line"))), lambda x: x["line"]), "\n").alias("block"))


@query("SELECT category, arg_min(canonical_name, program_id) AS example FROM program_registry GROUP BY category")
def prj14_examples(spark, folder):
    return Tables(spark, folder).program_registry.groupBy("category").agg(F.min_by("canonical_name", "program_id").alias("example"))


_SAID = "coalesce(lower({c}) NOT IN ('not specified', 'not found', ''), false)"
_BLOCK = "k || '. ' || coalesce(program_name, 'Unnamed program')" + "".join(
    f" || CASE WHEN {_SAID.format(c=c)} THEN chr(10) || '   {label}' || substr({c}, 1, {n}) || {dots} ELSE '' END"
    for c, label, n, dots in (("program_description", "", 160, "CASE WHEN length(program_description) > 160 THEN '...' ELSE '' END"), ("eligibility_requirements", "Eligibility: ", 120, "''"), ("application_process", "How to apply: ", 120, "''"), ("program_website_url", "Website: ", 1000, "''"))
)


@query(f"""WITH r AS (SELECT program_uid, county_code, min(record_id) AS record_id FROM structured_programs GROUP BY 1, 2), n AS (SELECT r.county_code, p.*, row_number() OVER (PARTITION BY r.county_code ORDER BY r.record_id) AS k FROM r JOIN structured_programs p USING (record_id))
    SELECT county_code, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY k) AS list FROM n GROUP BY county_code""")
def prj15_program_lists(spark, folder):
    """All programs of a county as numbered blocks; a list is one text, so a county's first records meet in its row."""
    t = Tables(spark, folder).structured_programs
    fields = ("record_id", "program_name", "program_description", "eligibility_requirements", "application_process", "program_website_url")
    first = t.groupBy("program_uid", "county_code").agg(F.min_by(F.struct(*fields), "record_id").alias("r")).select("county_code", "r")

    def part(c, label: str, n: int, dots: bool = False):
        tail = F.when(F.length(c) > n, "...").otherwise("") if dots else F.lit("")
        return F.when(F.coalesce(~F.lower(c).isin("not specified", "not found", ""), F.lit(False)), F.concat(F.lit("\n   " + label), F.substring(c, 1, n), tail)).otherwise("")

    def block(x, i):
        head = F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x["program_name"], F.lit("Unnamed program")))
        return F.concat(head, part(x["program_description"], "", 160, True), part(x["eligibility_requirements"], "Eligibility: ", 120), part(x["application_process"], "How to apply: ", 120), part(x["program_website_url"], "Website: ", 1000))

    return first.groupBy("county_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), block), "\n\n").alias("list"))


@query("""SELECT page_id, county, page_url, coalesce(link_text, '') AS link_text, coalesce(program_name_guess, '') AS program_name_guess, coalesce(nav_path, '') AS nav_path, scraped_at, length(text) AS n_chars, len(coalesce(contacts.phones, [])) AS phones, len(coalesce(contacts.emails, [])) AS emails,
    len(coalesce(pdf_links, [])) AS pdfs, len(coalesce(registry_signals, [])) AS n_signals, array_to_string(list_sort(coalesce(registry_signals, []))[1:10], '|') AS signals, coalesce(source_depth, 0) AS depth, coalesce(scraper_version, '') AS version FROM raw_pages""")
def prj17_records(spark, folder):
    """The record of a page, with ten signals at most."""
    none = F.array().cast("array<string>")
    s, empty = F.coalesce("registry_signals", none), F.lit("")
    size = lambda c: F.size(F.coalesce(c, none)).cast("long")
    return Tables(spark, folder).raw_pages.select(
        "page_id", "county", "page_url", *[F.coalesce(c, empty).alias(c) for c in ("link_text", "program_name_guess", "nav_path")], "scraped_at", F.length("text").cast("long").alias("n_chars"), size("contacts.phones").alias("phones"), size("contacts.emails").alias("emails"),
        size("pdf_links").alias("pdfs"), F.size(s).cast("long").alias("n_signals"), F.array_join(F.slice(F.array_sort(s), 1, 10), "|").alias("signals"), F.coalesce("source_depth", F.lit(0)).alias("depth"), F.coalesce("scraper_version", empty).alias("version"),
    )


@query(f"""SELECT page_id, substr({collapse_sql('text')}, 1, 5000) AS text, array_to_string(list_sort(list_distinct(regexp_extract_all(substr({collapse_sql('text')}, 1, 5000), '\\(?[0-9]{{3}}\\)?[-. ]?[0-9]{{3}}[-. ]?[0-9]{{4}}')))[1:5], '|') AS phones FROM raw_pages WHERE text IS NOT NULL""")
def prj4_agent_pages(spark, folder):
    """PRJ4: the text that an agent reads: collapsed, 5,000 characters (its definition), five contacts."""
    own = Tables(spark, folder).raw_pages.where("text is not null").select("page_id", T.agent_text(F.col("text")).alias("text"))
    return own.select("page_id", "text", F.array_join(F.slice(T.phones(F.col("text")), 1, 5), "|").alias("phones"))


@query()
def prj1_parsed_pages(spark, folder):
    """Pages put into HTML and parsed again: name, text, contacts, links."""
    from millrace.operators.pages import parse_pages

    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("link_text", F.lit("")), F.lit("</title></head><body><nav>Menu</nav><main><p>"), F.replace(esc, F.lit("\n"), F.lit("</p><p>")), F.lit("</p><a href='/more#top'>More</a></main></body></html>"))
    pages = Tables(spark, folder).raw_pages.where("text is not null").select("page_id", "page_url", html.alias("html"))
    return parse_pages(pages, "page_id", "page_url", "html").select("id", "name", F.length("text").alias("n_chars"), F.array_join("phones", "|").alias("phones"), F.size("links").alias("n_links"))


_TITLE = "array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"SELECT record_id, {_TITLE.format(c="replace(lower(trim(county_name)), '_', ' ')")} AS back, nullif(regexp_replace({host_sql('county_website_url')}, '^www\\.', ''), '') AS domain FROM structured_counties WHERE county_name IS NOT NULL")
def fn_places(spark, folder):
    """The county of a collection's name, and the domain of its website."""
    t = Tables(spark, folder).structured_counties.where("county_name is not null")
    return t.select("record_id", county_of_collection(collection_name(F.col("county_name"))).alias("back"), county_domain(F.col("county_website_url")).alias("domain"))


@query("SELECT page_id, strftime(scraped_at, '%Y%m%d_%H%M%S') || '_abcdef0_' || substr(md5('{\"k\": 10}'), 1, 8) AS run_id, strftime(scraped_at, '%Y-%m-%d') AS day FROM raw_pages WHERE scraped_at IS NOT NULL")
def fn_run_keys(spark, folder):
    t = Tables(spark, folder).raw_pages.where("scraped_at is not null")
    return t.select("page_id", T.run_id(F.col("scraped_at"), "abcdef0123", '{"k": 10}').alias("run_id"), F.date_format("scraped_at", "yyyy-MM-dd").alias("day"))


@query("SELECT p.record_id, coalesce(c.category_id, 'none') AS category_id FROM structured_programs p LEFT JOIN category_list c ON c.category_name = p.program_category")
def fn_map_probe(spark, folder):
    """A map built of a dimension of fixed size and probed with a default."""
    t = Tables(spark, folder)
    built = t.category_list.agg(F.map_from_entries(F.collect_list(F.struct("category_name", "category_id"))).alias("m"))
    own = t.structured_programs.select("record_id", "program_category").crossJoin(F.broadcast(built))
    return own.select("record_id", F.coalesce(F.try_element_at("m", F.coalesce("program_category", F.lit(""))), F.lit("none")).alias("category_id"))


@query("SELECT result_id, '{\"id\":' || result_id || ',\"tier\":\"' || coalesce(discovery_tier, '') || '\"}' AS doc, coalesce(discovery_tier, '') AS tier FROM discovery_results")
def fn_json_out(spark, folder):
    doc = F.to_json(F.struct(F.col("result_id").alias("id"), F.coalesce("discovery_tier", F.lit("")).alias("tier")))
    return Tables(spark, folder).discovery_results.select("result_id", doc.alias("doc"), F.get_json_object(doc, "$.tier").alias("tier"))


@query("SELECT category_id, array_to_string(also_written, '|') AS listed, category_name AS scalar FROM category_list")
def fn_list_or_scalar(spark, folder):
    t = Tables(spark, folder).category_list
    return t.select("category_id", F.array_join(T.list_or_scalar(F.to_json("also_written")), "|").alias("listed"), F.array_join(T.list_or_scalar(F.col("category_name")), "|").alias("scalar"))


@query("SELECT record_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(substr(data_version, 2) AS DOUBLE) / 5, 0)))::DOUBLE AS share, coalesce(TRY_CAST(last_updated AS DOUBLE), 0) > 0 AS is_number, nullif(regexp_extract(trim(notes), '^(\\d{5})(?:-\\d{4})?$', 1), '') AS zip FROM structured_programs")
def fn_numbers(spark, folder):
    t = Tables(spark, folder).structured_programs
    return t.select("record_id", T.clamped((F.substring("data_version", 2, 9).try_cast("double") / 5).cast("string")).alias("share"), (F.coalesce(F.col("last_updated").try_cast("double"), F.lit(0.0)) > 0).alias("is_number"), T.zip_code(F.col("notes")).alias("zip"))


_FINAL = "CASE WHEN coalesce(NOT starts_with(lower(page_url), 'http'), true) THEN 'failed' WHEN coalesce(length(text), 0) < 200 THEN 'failed' WHEN contacts IS NULL THEN 'partial' ELSE 'done' END"


@query(f"SELECT page_id, {_FINAL} AS state, CASE WHEN coalesce(NOT starts_with(lower(page_url), 'http'), true) THEN 1 WHEN coalesce(length(text), 0) < 200 THEN 2 ELSE 3 END AS steps FROM raw_pages")
def str5_agent_states(spark, folder):
    """STR5: each page through the states of an agent, ten transitions at most."""
    s = F.col("state")
    step = (
        F.when((s == "search") & F.coalesce(F.lower("page_url").startswith("http"), F.lit(False)), "fetch").when(s == "search", "failed")
        .when((s == "fetch") & (F.coalesce(F.length("text"), F.lit(0)) >= 200), "verify").when(s == "fetch", "failed")
        .when((s == "verify") & F.col("contacts").isNull(), "partial").when(s == "verify", "done").otherwise(s)
    )
    return run_states(Tables(spark, folder).raw_pages.withColumn("state", F.lit("search")), step).select("page_id", "state", "steps")


@query("""WITH t AS (SELECT page_id, county, text AS t FROM raw_pages WHERE length(trim(text)) >= 80 AND county IS NOT NULL), s AS (SELECT page_id, county, t, unnest(range(0, greatest(0, length(t) - 101) + 1, 700)) AS s FROM t)
    SELECT 'county_' || replace(lower(trim(county)), ' ', '_') AS collection, count(DISTINCT page_id) AS pages, count(*) AS chunks FROM s WHERE length(trim(substr(t, s + 1, 800))) >= 80 GROUP BY 1""")
def cmp12_collections(spark, folder):
    """CMP12: the chunks of each county's collection, as build_collections writes them."""
    from millrace.operators.retrieve import fixed_chunks

    t = Tables(spark, folder).raw_pages.where("county is not null").select(F.struct("page_id", collection_name(F.col("county")).alias("collection")).alias("key"), "text")
    chunks = fixed_chunks(t, "key", F.col("text"))
    return chunks.groupBy(F.col("id.collection").alias("collection")).agg(F.countDistinct("id.page_id").alias("pages"), F.count("*").alias("chunks"))


@query()
def win7_recursive_chunks(spark, folder):
    """WIN7: chunks cut at the strongest separators; tested by their properties."""
    t = spread(Tables(spark, folder).documents.select("doc_id", "text"), "doc_id")
    return recursive_chunks(t, "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")
