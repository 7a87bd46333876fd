"""Discovery: scored extraction of links, seed pages, cascades, picks from search results, batches of pages and PDFs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators import links as L
from millrace.operators.ordering import top_per_group
from millrace.plans.base import ALIAS_SQL, KEYWORD_SQL, Tables, host_sql, parts_sql, query, sql_list
from millrace.plans.scan import _EXCLUDED

_BOTH = "lower(coalesce(link_text, '') || ' ' || coalesce(url, ''))"
_KEY = "regexp_replace(regexp_replace(lower({c}), '[?#].*$', ''), '/+$', '')"
_BASIC = f"len(list_filter({sql_list(G.BASIC_KEYWORDS)}, lambda k: contains({{c}}, k))) > 0"
_TYPES = "kw AS (SELECT category_id AS type, trim(lower(w)) AS word, len(string_split(trim(w), ' ')) AS weight FROM (SELECT category_id, unnest(also_written) AS w FROM category_list))"
_SCORED = f"""{ALIAS_SQL}, {KEYWORD_SQL}, {_TYPES}, l AS (SELECT *, {_BOTH} AS b, trim(lower(coalesce(link_text, ''))) AS t, {parts_sql("coalesce(url, '')")} AS parts
        FROM (SELECT result_id, county_code, unnest(range(0, len(programs))) AS ord, unnest(programs).url AS url, unnest(programs).link_text AS link_text, coalesce(county_url, '') AS base FROM discovery_results)),
    k AS (SELECT *, (SELECT count(*) FROM keyword WHERE contains(b, word)) AS hits, {host_sql('url')} = {host_sql('base')} OR ends_with({host_sql('url')}, '.' || {host_sql('base')}) AS same FROM l),
    sc AS (SELECT *, (CASE WHEN list_has_any(parts, {sql_list(G.BAD_SEGMENTS)}) OR t = '' OR list_contains({sql_list(G.GENERIC_TEXTS)}, t) THEN 0 ELSE
        CASE WHEN EXISTS (SELECT 1 FROM alias WHERE contains(b, alias)) THEN 3.0 ELSE 0 END + CASE WHEN hits > 0 THEN 2.0 + least(1.0, hits / 5.0) ELSE 0 END
        - CASE WHEN len(list_filter({sql_list(G.SOCIAL_HOSTS)}, lambda h: contains(coalesce(url, ''), h))) > 0 THEN 5.0 ELSE 0 END
        - CASE WHEN len(list_filter({sql_list(_EXCLUDED)}, lambda h: contains(b, h))) > 0 AND hits = 0 THEN 3.0 ELSE 0 END END)::DOUBLE AS score FROM k)"""


def _extract_sql(name: str, least: float, most: int, external: bool) -> str:
    """CTEs name: the program links of each result."""
    score = f"CASE WHEN score >= {least} THEN score {'WHEN ' + _BASIC.format(c='b') + ' THEN 0.2' if least <= 0.1 else ''} END"
    return f"""{name}_k AS (SELECT * REPLACE ({score} AS score) FROM sc WHERE {'true' if external else 'same'}), {name}_f AS (SELECT *, coalesce(link_text, '') AS lt, row_number() OVER (PARTITION BY result_id, url ORDER BY ord) AS rn FROM {name}_k WHERE score IS NOT NULL),
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY score DESC, url DESC, lt DESC) AS rank FROM {name}_f WHERE rn = 1),
    {name}_t AS (SELECT result_id, rank, type, sum(weight) AS w FROM {name}_r JOIN kw ON contains(b, word) GROUP BY 1, 2, 3), {name}_b AS (SELECT result_id, rank, arg_min(type, lpad((100000 - w)::BIGINT::VARCHAR, 6, '0') || type) AS type FROM {name}_t GROUP BY 1, 2),
    {name} AS (SELECT r.result_id, r.url, r.lt AS link_text, round(r.score, 2) AS score, r.rank, coalesce(b.type, 'Unknown') AS category FROM {name}_r r LEFT JOIN {name}_b b ON b.result_id = r.result_id AND b.rank = r.rank WHERE r.rank <= {most})"""


def _types(t):
    return t.category_list.select(F.col("category_id").alias("type"), F.explode("also_written").alias("w")).select("type", F.trim(F.lower("w")).alias("word"), F.size(F.split(F.trim("w"), " ")).alias("weight"))


def _scored(t):
    links = t.discovery_results.select("result_id", F.coalesce("county_url", F.lit("")).alias("base"), F.posexplode("programs").alias("ord", "p")).select("result_id", "base", "ord", "p.url", "p.link_text")
    return L.scored_links(links, t.aliases(), t.keywords(), _EXCLUDED)


@query(f"WITH {_SCORED}, {_extract_sql('x', 1.0, 30, False)} SELECT * FROM x")
def cmp2_program_links(spark, folder):
    """CMP2: duplicates, domain filter, score, threshold, order, limit, category."""
    t = Tables(spark, folder)
    return L.program_links(_scored(t), "result_id", _types(t)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SCORED}, {_extract_sql('x', 0.1, 80, True)} SELECT * FROM x")
def cmp2_relaxed_links(spark, folder):
    """As cmp2_program_links, relaxed: other domains, links with a basic word rescued, 80 a result."""
    t = Tables(spark, folder)
    return L.program_links(_scored(t), "result_id", _types(t), 0.1, 80, True).withColumn("rank", F.col("rank").cast("long"))


_SEEDS = f"""s AS (SELECT page_id, coalesce(nullif(trim(program_name_guess), ''), nullif(trim(link_text), ''), 'Maternal Program') AS name, lower(coalesce(text, '') || ' ' || coalesce(page_url, '')) AS low FROM raw_pages WHERE NOT coalesce(contains(lower(page_url), 'pdf'), false)),
    sk AS (SELECT *, (SELECT count(*) FROM keyword WHERE contains(low, word)) AS hits, {_BASIC.format(c="(low || ' ' || lower(name))")} AS basic FROM s),
    st AS (SELECT page_id, type, sum(weight) AS w FROM s JOIN kw ON contains(low, word) GROUP BY 1, 2), sb AS (SELECT page_id, arg_min(type, lpad((100000 - w)::BIGINT::VARCHAR, 6, '0') || type) AS type FROM st GROUP BY 1)"""


@query(f"WITH {KEYWORD_SQL}, {_TYPES}, {_SEEDS} SELECT page_id, name, coalesce(type, 'Unknown') AS category, round(2.0 + 2.0 * least(1.0, hits / 5.0), 2)::DOUBLE AS score FROM sk LEFT JOIN sb USING (page_id) WHERE basic OR type IS NOT NULL")
def cmp3_seed_programs(spark, folder):
    """CMP3: the pages that are programs themselves; the whole text counts."""
    t = Tables(spark, folder)
    pages = t.raw_pages.select("page_id", F.col("page_url").alias("url"), F.col("program_name_guess").alias("heading"), F.col("link_text").alias("title"), "text")
    return L.seed_programs(pages, "page_id", _types(t), t.keywords()).withColumnRenamed("id", "page_id")


@query(f"""WITH {_SCORED}, {_extract_sql('a', 1.0, 30, False)}, {_extract_sql('b', 0.1, 80, True)},
    s AS (SELECT result_id, maternal_section_url AS url FROM discovery_results WHERE trim(maternal_section_url) <> '' AND NOT contains(lower(maternal_section_url), 'pdf') AND {_BASIC.format(c='lower(maternal_section_url)')}),
    d AS (SELECT result_id, county_url AS url FROM discovery_results WHERE trim(county_url) <> ''),
    u AS (SELECT result_id, url, 'strict' AS tier, 1 AS p FROM a UNION ALL SELECT result_id, url, 'relaxed', 2 FROM b UNION ALL SELECT result_id, url, 'seed page', 3 FROM s UNION ALL SELECT result_id, url, 'fallback', 4 FROM d)
    SELECT result_id, url, tier FROM u WHERE p = (SELECT min(p) FROM u v WHERE v.result_id = u.result_id)""")
def cmp1_discovery(spark, folder):
    """CMP1: of each result the links of the first strategy that gives any: strict, relaxed, the seed itself, the root."""
    t = Tables(spark, folder)
    scored, types, r = _scored(t), _types(t), t.discovery_results
    seed = r.where((F.trim("maternal_section_url") != "") & ~F.lower("maternal_section_url").contains("pdf") & T.holds_any(F.lower("maternal_section_url"), G.BASIC_KEYWORDS))
    return L.cascade(
        [
            ("strict", L.program_links(scored, "result_id", types).select("result_id", "url")),
            ("relaxed", L.program_links(scored, "result_id", types, 0.1, 80, True).select("result_id", "url")),
            ("seed page", seed.select("result_id", F.col("maternal_section_url").alias("url"))),
            ("fallback", r.where(F.trim("county_url") != "").select("result_id", F.col("county_url").alias("url"))),
        ],
        "result_id",
    )


@query(f"SELECT result_id, url FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ord) AS rn FROM (SELECT result_id, url, min(ord) AS ord FROM (SELECT result_id, unnest(range(0, len(programs))) AS ord, unnest(programs).url AS url, unnest(programs).link_text AS t FROM discovery_results) WHERE {_BASIC.format(c='lower(t)')} AND url IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 10")
def cmp5_keyword_links(spark, folder):
    """CMP5: links with a keyword in their text, each URL once, the first ten of a result."""
    own = Tables(spark, folder).discovery_results.select("result_id", F.posexplode("programs").alias("ord", "p"))
    hits = own.where(T.holds_any(F.lower("p.link_text"), G.BASIC_KEYWORDS) & F.col("p.url").isNotNull()).groupBy("result_id", F.col("p.url").alias("url")).agg(F.min("ord").alias("ord"))
    return top_per_group(hits, ["result_id"], [F.col("ord")], 10).select("result_id", "url")


_RESULTS = f"r AS (SELECT county_code, result_id AS template, unnest(range(0, len(programs))) AS pos, unnest(programs).url AS url, nullif(regexp_replace({host_sql('county_url')}, '^www\\.', ''), '') AS domain FROM discovery_results)"


def _results(t):
    own = t.discovery_results.select("county_code", F.col("result_id").alias("template"), L.county_domain(F.col("county_url")).alias("domain"), F.posexplode("programs").alias("pos", "p"))
    return own.select("county_code", "template", "pos", "p.url", "domain")


@query(f"""WITH {_RESULTS}, g AS (SELECT *, coalesce(contains(url, domain), false) AS own FROM r WHERE url <> '' AND NOT contains(lower(url), 'pdf'))
    SELECT county_code, arg_min(url, lpad(template::VARCHAR, 12, '0') || CASE WHEN own THEN '0' ELSE '1' END || lpad(pos::VARCHAR, 6, '0')) AS url FROM g WHERE own OR regexp_matches(lower(url), '\\.(gov|us)(/|$)') GROUP BY 1""")
def cmp4_search_pick(spark, folder):
    """CMP4: results of discovery as search results, a template each."""
    return L.pick_result(_results(Tables(spark, folder)), "county_code")


@query(f"""WITH {_RESULTS}, g AS (SELECT county_code, url, min(lpad(template::VARCHAR, 12, '0') || lpad(pos::VARCHAR, 6, '0')) AS o FROM r WHERE starts_with(url, 'http') AND NOT contains(lower(url), 'pdf')
    AND CASE WHEN domain IS NOT NULL THEN contains(url, domain) ELSE regexp_matches(lower(url), '\\.(gov|us)(/|$)') END GROUP BY 1, 2)
    SELECT county_code, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY county_code ORDER BY o, url) AS rank FROM g) WHERE rank <= 6""")
def cmp4_search_candidates(spark, folder):
    return L.candidate_results(_results(Tables(spark, folder)), "county_code")


_COUNTY = "trim(regexp_replace(lower(trim({c})), '(^|\\s+)county$', ''))"


@query(f"""WITH s AS (SELECT DISTINCT county_code, {_KEY.format(c='maternal_section_url')} AS url FROM discovery_results WHERE trim(maternal_section_url) <> ''), d AS (SELECT DISTINCT county_code, {_KEY.format(c='p.url')} AS url FROM (SELECT county_code, unnest(programs) AS p FROM discovery_results) WHERE p.url IS NOT NULL)
    SELECT county_code, url, 'seed' AS source FROM s UNION ALL SELECT county_code, url, 'links' FROM d WHERE county_code NOT IN (SELECT county_code FROM s)""")
def cmp7_batch_sources(spark, folder):
    """CMP7: a county's seed, or, for counties without one, the links found before."""
    t = Tables(spark, folder).discovery_results
    seeds = t.where(F.trim("maternal_section_url") != "").select("county_code", T.url_key(F.col("maternal_section_url")).alias("url"), F.lit("seed").alias("source")).distinct()
    found = t.select("county_code", F.explode("programs").alias("p")).where("p.url is not null").select("county_code", T.url_key(F.col("p.url")).alias("url"), F.lit("links").alias("source")).distinct()
    return L.else_from(seeds, found, "county_code")


@query("""WITH p AS (SELECT county, page_url, pdf_links, coalesce(source_depth, 99) AS depth, row_number() OVER (PARTITION BY county ORDER BY coalesce(source_depth, 99), page_id) AS rank FROM raw_pages WHERE county IS NOT NULL), k AS (SELECT * FROM p WHERE rank <= 30),
    d AS (SELECT county, url, min(rank * 1000 + pos) AS o FROM (SELECT county, rank, unnest(pdf_links) AS url, unnest(range(0, len(pdf_links))) AS pos FROM k) GROUP BY 1, 2)
    SELECT county, page_url AS url, depth::INT AS depth, 'page' AS kind FROM k UNION ALL SELECT county, url, 99, 'pdf' FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY o, url) AS n FROM d) WHERE n <= 5""")
def cmp8_pages_then_pdfs(spark, folder):
    """CMP8, WIN10: thirty pages a county by depth, then five different PDFs of theirs, at depth 99."""
    t = Tables(spark, folder).raw_pages.where("county is not null").select("page_id", "county", "page_url", "pdf_links", F.coalesce("source_depth", F.lit(99)).alias("depth"))
    pages = top_per_group(t, ["county"], [F.col("depth"), F.col("page_id")], 30)
    each = pages.select("county", "rank", F.posexplode("pdf_links").alias("pos", "url")).groupBy("county", "url").agg(F.min(F.col("rank") * 1000 + F.col("pos")).alias("o"))
    pdfs = top_per_group(each, ["county"], [F.col("o"), F.col("url")], 5, "n")
    return pages.select("county", F.col("page_url").alias("url"), "depth", F.lit("page").alias("kind")).unionByName(pdfs.select("county", "url", F.lit(99).alias("depth"), F.lit("pdf").alias("kind")))
