"""Reports, evaluation runs and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators import metrics as E
from millrace.operators import ordering as O
from millrace.operators.boundary import complete, parse_reply
from millrace.operators.retrieve import nearest
from millrace.operators.terms import held_terms
from millrace.plans.base import ALIAS_SQL, Tables, host_sql, query, sql_list

_KEY = "regexp_replace(regexp_replace(lower({c}), '[?#].*$', ''), '/+$', '')"
_GOLD = "source_system = 'manual_override'"


@query("SELECT page_id, len(list_filter(coalesce(pdf_links, []), lambda u: regexp_matches(lower(u), '\\.pdf$') OR contains(lower(u), 'getfile'))) AS pdf_seeds FROM raw_pages")
def prd15_pdf_seeds(spark, folder):
    pdfs = F.filter(F.coalesce("pdf_links", F.array().cast("array<string>")), lambda u: F.lower(u).rlike(r"\.pdf$") | F.lower(u).contains("getfile"))
    return Tables(spark, folder).raw_pages.select("page_id", F.size(pdfs).cast("long").alias("pdf_seeds"))


@query("""SELECT record_id, least(5, greatest(1, coalesce(source_trust, 0))) AS trust, CASE WHEN financial_assistance_available IN ('Yes', 'No', 'Unknown') THEN financial_assistance_available WHEN lower(financial_assistance_available) = 'yes' THEN 'Yes' WHEN lower(financial_assistance_available) = 'no' THEN 'No' ELSE 'Unknown' END AS assistance,
    coalesce(c.category_id, 'OTHER') AS category_id FROM structured_programs p LEFT JOIN category_list c ON lower(trim(p.program_category)) = lower(c.category_name)""")
def prj9_sanitized(spark, folder):
    """Numbers clamped, choices held to their list, the category's id filled in."""
    t = Tables(spark, folder)
    a = F.col("financial_assistance_available")
    kind = F.when(a.isin("Yes", "No", "Unknown"), a).when(F.lower(a) == "yes", "Yes").when(F.lower(a) == "no", "No").otherwise("Unknown")
    cats = t.category_list.select(F.lower("category_name").alias("k"), "category_id")
    own = t.structured_programs.select("record_id", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce("source_trust", F.lit(0)))).alias("trust"), kind.alias("assistance"), F.lower(F.trim("program_category")).alias("k"))
    return own.join(cats, "k", "left").select("record_id", "trust", "assistance", F.coalesce("category_id", F.lit("OTHER")).alias("category_id"))


@query(f"SELECT DISTINCT {_KEY.format(c='url')} AS url FROM (SELECT unnest(programs).url AS url FROM discovery_results) WHERE url IS NOT NULL AND {_KEY.format(c='url')} NOT IN (SELECT {_KEY.format(c='page_url')} FROM raw_pages WHERE page_url IS NOT NULL)")
def jon15_frontier(spark, folder):
    """Links found that no page was read from."""
    t = Tables(spark, folder)
    found = t.discovery_results.select(F.explode("programs").alias("p")).where("p.url is not null").select(T.url_key(F.col("p.url")).alias("url")).distinct()
    return found.join(t.raw_pages.where("page_url is not null").select(T.url_key(F.col("page_url")).alias("url")), "url", "left_anti")


@query(f"SELECT page_id FROM raw_pages WHERE {host_sql('page_url')} IN (SELECT {host_sql('u')} FROM (SELECT unnest(programs).url AS u FROM discovery_results) WHERE u IS NOT NULL)")
def jon16_discovered_hosts(spark, folder):
    """Pages of hosts that discovery found."""
    t = Tables(spark, folder)
    hosts = t.discovery_results.select(F.explode("programs").alias("p")).where("p.url is not null").select(T.url_host(F.col("p.url")).alias("k")).distinct()
    return t.raw_pages.select("page_id", T.url_host(F.col("page_url")).alias("k")).join(hosts, "k", "left_semi").select("page_id")


@query("SELECT c_custkey, regexp_replace(n_name, ' County$', '') AS place, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jon18_place_lookup(spark, folder):
    """A key looked up in a small dimension; the planner broadcasts it by its size."""
    t = Tables(spark, folder)
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.regexp_replace("n_name", " County$", "").alias("place"), F.col("r_name").alias("region"))
    return t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "place", "region")


@query("WITH v AS (SELECT data_version, county_code, count(*) AS n FROM structured_programs GROUP BY 1, 2) SELECT data_version, round(avg(n), 6) AS mean, max(n) AS most, min(n) AS least FROM v GROUP BY 1")
def agg14_version_means(spark, folder):
    v = Tables(spark, folder).structured_programs.groupBy("data_version", "county_code").agg(F.count("*").alias("n"))
    return v.groupBy("data_version").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))


@query("WITH v AS (SELECT county_code, data_version, count(*) AS n FROM structured_programs GROUP BY 1, 2) SELECT county_code, arg_min(data_version, lpad((100000 - n)::VARCHAR, 8, '0') || data_version) AS best FROM v GROUP BY 1")
def agg15_best_version(spark, folder):
    v = Tables(spark, folder).structured_programs.groupBy("county_code", "data_version").agg(F.count("*").alias("n"))
    return O.argmax(v, ["county_code"], F.col("n"), F.col("data_version"), ["data_version"]).select("county_code", F.col("data_version").alias("best"))


_PR = f"""WITH g AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE {_GOLD} AND program_website_url IS NOT NULL), f AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE NOT {_GOLD} AND program_website_url IS NOT NULL),
    b AS (SELECT coalesce(g.county_code, f.county_code) AS county_code, g.k IS NOT NULL AS ig, f.k IS NOT NULL AS if FROM g FULL JOIN f ON g.county_code = f.county_code AND g.k = f.k), c AS (SELECT county_code, count(*) FILTER (WHERE ig AND if) AS tp, count(*) FILTER (WHERE if AND NOT ig) AS fp, count(*) FILTER (WHERE ig AND NOT if) AS fn FROM b GROUP BY 1),
    m AS (SELECT avg(round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6)) AS p, avg(round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6)) AS r FROM c)"""


def _pr(spark, folder):
    t = Tables(spark, folder).structured_programs.where("program_website_url is not null").withColumn("k", T.url_key(F.col("program_website_url")))
    return E.precision_recall(t.where(_GOLD), t.where(f"not {_GOLD}"), "county_code", "k")


@query(_PR + " SELECT round(p, 5) AS precision, round(r, 5) AS recall, round(2 * p * r / (p + r), 5) AS f1 FROM m")
def agg17_macro_f1(spark, folder):
    """AGG18: macro averages, and F1 from the averages."""
    m = _pr(spark, folder).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    return m.select(F.round("p", 5).alias("precision"), F.round("r", 5).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 5).alias("f1"))


@query("SELECT category, count(DISTINCT service) AS services FROM (SELECT category, unnest(core_services) AS service FROM program_registry) GROUP BY 1")
def agg21_distinct_services(spark, folder):
    return Tables(spark, folder).program_registry.select("category", F.explode("core_services").alias("s")).groupBy("category").agg(F.countDistinct("s").alias("services"))


@query("SELECT count(DISTINCT county) AS collections, count(*) FILTER (WHERE length(trim(text)) >= 80) AS indexed, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) < 80) AS skipped FROM documents")
def agg23_build_counters(spark, folder):
    n = F.coalesce(F.length(F.trim("text")), F.lit(0))
    return Tables(spark, folder).documents.agg(F.countDistinct("county").alias("collections"), F.count_if(n >= 80).alias("indexed"), F.count_if(n < 80).alias("skipped"))


@query("SELECT result_id, url, rank FROM (SELECT result_id, url, row_number() OVER (PARTITION BY result_id ORDER BY coalesce(score, 0) DESC, ord) AS rank FROM (SELECT result_id, unnest(programs).url AS url, unnest(programs).score AS score, unnest(range(0, len(programs))) AS ord FROM discovery_results)) WHERE rank <= 10")
def top3_fetched(spark, folder):
    """The ten best links of a result; equal scores keep their order."""
    t = Tables(spark, folder).discovery_results.select("result_id", F.posexplode("programs").alias("ord", "p")).select("result_id", "ord", "p.url", F.coalesce("p.score", F.lit(0.0)).alias("score"))
    return O.top_per_group(t, ["result_id"], [F.col("score").desc(), F.col("ord")], 10).select("result_id", "url", F.col("rank").cast("long").alias("rank"))


@query("SELECT program_id, 'all' AS section FROM program_registry WHERE state_specific IS NULL UNION ALL SELECT program_id, state_specific FROM program_registry WHERE state_specific IN ('CA', 'IN', 'TX')")
def set1_sections(spark, folder):
    t = Tables(spark, folder).program_registry
    out = t.where("state_specific is null").select("program_id", F.lit("all").alias("section"))
    for s in ("CA", "IN", "TX"):
        out = out.unionByName(t.where(F.col("state_specific") == s).select("program_id", F.col("state_specific").alias("section")))
    return out


@query("""WITH c AS (SELECT DISTINCT county_code FROM structured_counties), p AS (SELECT county_code, count(*) AS n, avg(length(coalesce(program_description, ''))) AS chars FROM structured_programs GROUP BY 1)
    SELECT county_code, 'missing' AS why FROM c WHERE county_code NOT IN (SELECT county_code FROM p) UNION ALL SELECT county_code, 'few' FROM p WHERE n < 10 UNION ALL SELECT county_code, 'thin' FROM p WHERE n >= 10 AND chars < 100""")
def set5_rerun_list(spark, folder):
    """EVL12: what to read again, and why."""
    t = Tables(spark, folder)
    p = t.structured_programs.groupBy("county_code").agg(F.count("*").alias("n"), F.avg(F.length(F.coalesce("program_description", F.lit("")))).alias("chars"))
    missing = t.structured_counties.select("county_code").distinct().join(p, "county_code", "left_anti").select("county_code", F.lit("missing").alias("why"))
    return missing.unionByName(p.where("n < 10").select("county_code", F.lit("few").alias("why"))).unionByName(p.where("n >= 10 and chars < 100").select("county_code", F.lit("thin").alias("why")))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(coalesce(contacts.phones, []), lambda p: translate(p, '-() ', '')), list_transform(coalesce(contacts.emails, []), lambda e: lower(e))))), '|') AS contacts FROM raw_pages""")
def set7_contact_union(spark, folder):
    none = F.array().cast("array<string>")
    p = F.transform(F.coalesce("contacts.phones", none), lambda x: F.translate(x, "-() ", ""))
    e = F.transform(F.coalesce("contacts.emails", none), lambda x: F.lower(x))
    return Tables(spark, folder).raw_pages.select("page_id", F.array_join(F.array_sort(F.array_union(p, e)), "|").alias("contacts"))


@query("""SELECT p.county_code, count(*) AS answers, count(*) FILTER (WHERE p.program_uid IN (SELECT program_uid FROM structured_programs WHERE source_system = 'manual_override')) AS hits FROM (SELECT DISTINCT county_code, program_uid FROM structured_programs WHERE data_version = 'v5') p GROUP BY 1""")
def evl9_answers(spark, folder):
    t = Tables(spark, folder).structured_programs
    gold = t.where(_GOLD).select("program_uid").distinct().withColumn("hit", F.lit(1))
    shown = t.where("data_version = 'v5'").select("county_code", "program_uid").distinct()
    return shown.join(gold, "program_uid", "left").groupBy("county_code").agg(F.count("*").alias("answers"), F.count("hit").alias("hits"))


@query(_PR + """, fl AS (SELECT data_version, round(avg(CASE WHEN coalesce(trim(lower(eligibility_requirements)) NOT IN ('not found', 'not specified', '', 'none', 'n/a'), false) THEN 1.0 ELSE 0 END), 6) AS fill FROM structured_programs GROUP BY 1)
    SELECT 'precision' AS metric, round(p, 5) AS value FROM m UNION ALL SELECT 'recall', round(r, 5) FROM m UNION ALL SELECT 'eligibility ' || data_version, fill::DOUBLE FROM fl""")
def evl4_full_run(spark, folder):
    """One long table of the measures of several suites."""
    m = _pr(spark, folder).agg(F.round(F.avg("precision"), 5).alias("precision"), F.round(F.avg("recall"), 5).alias("recall"))
    long = m.selectExpr("stack(2, 'precision', precision, 'recall', recall) as (metric, value)")
    fill = E.completeness(Tables(spark, folder).structured_programs, ["data_version"], {"fill": G.is_filled(F.col("eligibility_requirements"))})
    return long.unionByName(fill.select(F.concat(F.lit("eligibility "), F.col("data_version")).alias("metric"), F.col("fill").alias("value")))


@query("SELECT source_system, count(*) AS rows, count(DISTINCT county_code) AS counties, count(DISTINCT program_uid) AS programs, count(*) FILTER (WHERE program_website_url IS NOT NULL) AS with_url FROM structured_programs GROUP BY 1")
def evl13_summary(spark, folder):
    return Tables(spark, folder).structured_programs.groupBy("source_system").agg(F.count("*").alias("rows"), F.countDistinct("county_code").alias("counties"), F.countDistinct("program_uid").alias("programs"), F.count("program_website_url").alias("with_url"))


_CHAIN = f"""WITH {ALIAS_SQL}, p AS (SELECT page_id, page_url, trim(lower(coalesce(link_text, ''))) AS t, lower(coalesce(text, '')) AS low, sha1(lower(trim(regexp_replace(substr(text, 1, 2000), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS fp FROM raw_pages),
    s AS (SELECT page_id, fp, CASE WHEN coalesce(NOT starts_with(lower(page_url), 'http'), true) OR t IN (SELECT unnest({sql_list(G.GENERIC_TEXTS)})) THEN 'link' WHEN length(low) < 200 THEN 'short' WHEN NOT EXISTS (SELECT 1 FROM alias WHERE contains(low, alias)) THEN 'no signal' ELSE 'kept' END AS stage FROM p),
    d AS (SELECT page_id, CASE WHEN stage = 'kept' AND page_id <> min(page_id) OVER (PARTITION BY fp, stage) THEN 'duplicate' ELSE stage END AS stage FROM s)"""


@query(_CHAIN + " SELECT stage, count(*) AS pages FROM d GROUP BY 1")
def cmp6_page_chain(spark, folder):
    """The link's gate, the content's gate, duplicates; each page has the stage at which it ended."""
    t = Tables(spark, folder)
    p = t.raw_pages.select("page_id", F.lower("page_url").alias("u"), F.trim(F.lower(F.coalesce("link_text", F.lit("")))).alias("t"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), T.fingerprint(F.col("text")).alias("fp"))
    p = held_terms(p, F.col("low"), t.aliases())
    stage = F.when(F.coalesce(~F.col("u").startswith("http"), F.lit(True)) | F.col("t").isin(*G.GENERIC_TEXTS), "link").when(F.length("low") < 200, "short").when(F.size("held") == 0, "no signal").otherwise("kept")
    s = p.select("page_id", "fp", stage.alias("stage"))
    by_fp = s.groupBy("fp", "stage").agg(F.count("*").alias("n"))
    n = by_fp.select(F.when((F.col("stage") == "kept"), F.array(F.struct(F.lit("kept").alias("stage"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("stage"), (F.col("n") - 1).alias("n")))).otherwise(F.array(F.struct("stage", "n"))).alias("x"))
    return n.select(F.explode("x").alias("y")).select("y.*").where("n > 0").groupBy("stage").agg(F.sum("n").alias("pages"))


@query("""SELECT county_code, status, count(*) AS n FROM (SELECT county_code, CASE WHEN programs IS NULL OR len(programs) = 0 THEN 'error' ELSE discovery_tier END AS status FROM discovery_results) GROUP BY 1, 2""")
def cmp16_with_errors(spark, folder):
    """Results without links are rows of their own kind instead of vanishing."""
    t = Tables(spark, folder).discovery_results
    good = F.col("programs").isNotNull() & (F.size("programs") > 0)
    rows = t.where(good).select("county_code", F.col("discovery_tier").alias("status")).unionByName(t.where(~good).select("county_code", F.lit("error").alias("status")))
    return rows.groupBy("county_code", "status").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS n, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS sim FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, n) AS rank FROM s) SELECT query_id, string_agg('[' || rank || '] ' || coalesce(d.text, ''), chr(10) ORDER BY rank) AS context FROM r LEFT JOIN documents d ON d.doc_id = r.n WHERE rank <= 10 GROUP BY 1""")
def cmp14_context(spark, folder):
    """The whole texts of the nearest ten put together as a context."""
    t = Tables(spark, folder)
    near = nearest(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 10)
    docs = t.documents.select(F.col("doc_id").alias("neighbour_id"), F.coalesce("text", F.lit("")).alias("t"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("t", F.lit("")))
    rows = near.join(docs, "neighbour_id", "left").select("query_id", "rank", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


@query()
def cmp9_structured(spark, folder):
    """Prompts through the completion boundary (here its rule-based default) and the replies parsed."""
    t = Tables(spark, folder).raw_pages.where("text is not null").select("page_id", F.substring("text", 1, 10_000).alias("prompt"))
    return parse_reply(complete(t, "page_id", "prompt"))[0]
