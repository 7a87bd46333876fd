"""Evaluation suites: names against gold names, contacts, PDFs, structuring, answers, places, and the run of them all.

Gold are the records that were overridden by hand; what the other sources have is what was extracted."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators import metrics as E
from millrace.operators.links import name_matches
from millrace.operators.ordering import argmax, top_per_group
from millrace.plans.base import Tables, name_sql, query
from millrace.plans.evals import _ranked
from millrace.plans.match import _MATCH, _matched

_GOLD = "source_system = 'manual_override'"
_KEY = "regexp_replace(regexp_replace(lower({c}), '[?#].*$', ''), '/+$', '')"
_SET = "list_distinct(list_filter(string_split({n}, ' '), lambda w: w <> ''))"
#: Names of a county and version with rank, gold names, and the F1 of all pairs of a county.
_NAMES = f"""f AS (SELECT county_code, data_version, record_id, program_name AS f, row_number() OVER (PARTITION BY county_code, data_version ORDER BY record_id) AS rank FROM structured_programs WHERE NOT {_GOLD} AND program_name IS NOT NULL),
    g AS (SELECT DISTINCT county_code, program_name AS g FROM structured_programs WHERE {_GOLD} AND program_name IS NOT NULL), ng AS (SELECT county_code, count(*) AS n_gold FROM g GROUP BY 1),
    gs AS (SELECT *, {_SET.format(n=name_sql('g'))} AS gw FROM g), fs AS (SELECT *, {_SET.format(n=name_sql('f'))} AS fw FROM (SELECT DISTINCT county_code, f FROM f)),
    c AS (SELECT county_code, g, f, len(list_intersect(gw, fw))::DOUBLE AS n, len(gw) AS a, len(fw) AS b FROM gs JOIN fs USING (county_code)), pr AS (SELECT county_code, g, f, 2 * (n / b) * (n / a) / (n / b + n / a) AS f1 FROM c WHERE n > 0)"""
_B2 = f"""{_NAMES}, m AS (SELECT county_code, g, f FROM pr WHERE f1 >= 0.5), h AS (SELECT f.county_code, data_version, g, min(rank) AS rank FROM f JOIN m ON m.county_code = f.county_code AND m.f = f.f WHERE rank <= 20 GROUP BY 1, 2, 3),
    rel AS (SELECT county_code, data_version, rank FROM f WHERE (county_code, f) IN (SELECT county_code, f FROM m)), nr AS (SELECT county_code, data_version, count(*) AS n_rel FROM rel GROUP BY 1, 2), v AS (SELECT county_code, data_version, count(*) AS n_extracted FROM f JOIN ng USING (county_code) GROUP BY 1, 2),
    d AS (SELECT county_code, data_version, sum(1 / log2(rank + 1)) AS dcg FROM rel WHERE rank <= 10 GROUP BY 1, 2),
    b2 AS (SELECT v.county_code, v.data_version, n_extracted, n_gold, {', '.join(f"round((SELECT count(*) FROM h WHERE h.county_code = v.county_code AND h.data_version = v.data_version AND h.rank <= {k}) / n_gold::DOUBLE, 6) AS recall_at_{k}" for k in (5, 10, 20))},
        round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_at_10
        FROM v JOIN ng USING (county_code) LEFT JOIN nr ON nr.county_code = v.county_code AND nr.data_version = v.data_version LEFT JOIN d ON d.county_code = v.county_code AND d.data_version = v.data_version)"""


def _mean_sql(c: str) -> str:
    return f"(sum(round({c} * 1000000)::BIGINT) // count(*))::BIGINT / 1000000.0::DOUBLE"


def _mean(c: str):
    """The mean of values of six digits, cut to six digits: sums of integers, the same in any order of rows."""
    return F.expr(f"(sum(cast(round({c} * 1000000) as bigint)) div count(*)) / 1000000.0D")


def _names(t):
    own = t.structured_programs.where("program_name is not null")
    gold = own.where(_GOLD).select("county_code", "program_name").distinct()
    found = own.where(f"not {_GOLD}").select("county_code", "data_version", "record_id", "program_name")
    return gold, found, gold.groupBy("county_code").agg(F.count("*").alias("n_gold"))


def _name_retrieval(t):
    gold, found, n_gold = _names(t)
    key = ["county_code", "data_version"]
    pairs = name_matches(gold, found, "county_code", "program_name", "program_name", 0.5).withColumnRenamed("found_name", "program_name")
    relevant = found.join(pairs.select("county_code", "program_name").distinct(), ["county_code", "program_name"], "left_semi").groupBy(*key).agg(F.count("*").alias("n_rel"))
    top = top_per_group(found, key, [F.col("record_id")], 20)
    first = top.join(pairs, ["county_code", "program_name"]).groupBy(*key, "gold_name").agg(F.min("rank").alias("rank"))
    hits = first.groupBy(*key).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (5, 10, 20)])
    gains = top.where("rank <= 10").join(pairs.select("county_code", "program_name").distinct(), ["county_code", "program_name"], "left_semi").groupBy(*key).agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    base = found.groupBy(*key).agg(F.count("*").alias("n_extracted")).join(n_gold, "county_code")
    out = base.join(hits, key, "left").join(relevant, key, "left").join(gains, key, "left").fillna(0, ["h5", "h10", "h20", "n_rel"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.col("n_rel"), F.lit(1))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return out.select(*key, "n_extracted", "n_gold", *[F.round(F.col(f"h{k}") / F.col("n_gold"), 6).alias(f"recall_at_{k}") for k in (5, 10, 20)], F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg_at_10"))


@query(f"WITH {_B2} SELECT * FROM b2")
def evl6_name_retrieval(spark, folder):
    """EVL6, WIN3: recall of gold names among the first 5, 10 and 20 of a county and version, and NDCG; a name matches at
    a token F1 of 0.5. Only ranks up to 20 leave a group's window."""
    return _name_retrieval(Tables(spark, folder))


@query(f"WITH {_B2} SELECT data_version, {_mean_sql('recall_at_10')} AS recall, {_mean_sql('recall_at_20')} AS recall_20, {_mean_sql('ndcg_at_10')} AS ndcg, count(*) AS counties FROM b2 GROUP BY 1")
def agg14_version_scores(spark, folder):
    """AGG14: macro averages of each version."""
    b2 = _name_retrieval(Tables(spark, folder))
    return b2.groupBy("data_version").agg(_mean("recall_at_10").alias("recall"), _mean("recall_at_20").alias("recall_20"), _mean("ndcg_at_10").alias("ndcg"), F.count("*").alias("counties"))


_B3 = f"""{_NAMES}, v AS (SELECT DISTINCT county_code, data_version FROM f), bf AS (SELECT v.county_code, v.data_version, g.g, coalesce((SELECT max(f1) FROM pr JOIN f ON f.county_code = pr.county_code AND f.f = pr.f WHERE pr.county_code = v.county_code AND pr.g = g.g AND f.data_version = v.data_version), 0) AS f1 FROM v JOIN g USING (county_code)),
    b3 AS (SELECT county_code, data_version, round(avg(f1), 6) AS mean_f1, round(avg(CASE WHEN f1 = 1 THEN 1.0 ELSE 0 END), 6) AS exact_match_rate, count(*) FILTER (WHERE f1 >= 0.5) AS n_matched, count(*) AS n_gold FROM bf GROUP BY 1, 2)"""


def _best_f1(t):
    gold, found, n_gold = _names(t)
    key = ["county_code", "data_version"]
    pairs = name_matches(gold, found, "county_code", "program_name", "program_name").withColumnRenamed("found_name", "program_name")
    best = found.select(*key, "program_name").distinct().join(pairs, ["county_code", "program_name"]).groupBy(*key, "gold_name").agg(F.max("f1").alias("f1"))
    sums = best.groupBy(*key).agg(F.sum("f1").alias("s"), F.count_if(F.col("f1") == 1.0).alias("e"), F.count_if(F.col("f1") >= 0.5).alias("n_matched"))
    out = found.select(*key).distinct().join(n_gold, "county_code").join(sums, key, "left").fillna(0, ["s", "e", "n_matched"])
    return out.select(*key, F.round(F.col("s") / F.col("n_gold"), 6).alias("mean_f1"), F.round(F.col("e") / F.col("n_gold"), 6).alias("exact_match_rate"), "n_matched", "n_gold")


@query(f"WITH {_B3} SELECT * FROM b3")
def evl7_name_quality(spark, folder):
    """EVL7, JON10: of each county and version the mean best F1 of gold names, the rate of exact matches, the matched."""
    return _best_f1(Tables(spark, folder))


@query(f"WITH {_B3} SELECT county_code, arg_min(data_version, lpad((1000000 - mean_f1 * 1000000)::BIGINT::VARCHAR, 8, '0') || data_version) AS best, max(mean_f1) AS mean_f1 FROM b3 GROUP BY 1")
def agg15_best_by_f1(spark, folder):
    """AGG15: the version with the best mean F1 of each county, of equals the first."""
    return argmax(_best_f1(Tables(spark, folder)), ["county_code"], F.col("mean_f1"), F.col("data_version"), ["data_version", "mean_f1"]).select("county_code", F.col("data_version").alias("best"), "mean_f1")


@query(f"""WITH {_NAMES}, m AS (SELECT county_code, g, f FROM pr WHERE f1 >= 0.5), a AS (SELECT county_code, f FROM f WHERE data_version = 'v5'),
    r AS (SELECT county_code, count(*) AS n_returned, count(*) FILTER (WHERE (county_code, f) IN (SELECT county_code, f FROM m)) AS good FROM a GROUP BY 1), k AS (SELECT m.county_code, count(DISTINCT g) AS recalled FROM m JOIN a ON a.county_code = m.county_code AND a.f = m.f GROUP BY 1)
    SELECT county_code, n_gold, coalesce(n_returned, 0) AS n_returned, round(coalesce(recalled, 0) / n_gold::DOUBLE, 6) AS answer_recall, round(coalesce(good / n_returned::DOUBLE, 0), 6) AS answer_precision FROM ng LEFT JOIN r USING (county_code) LEFT JOIN k USING (county_code)""")
def evl9_answer_quality(spark, folder):
    """EVL9: what the latest version answers for a county, against its gold names."""
    gold, found, n_gold = _names(Tables(spark, folder))
    shown = found.where("data_version = 'v5'").select("county_code", "program_name")
    pairs = name_matches(gold, shown, "county_code", "program_name", "program_name", 0.5)
    good = pairs.select("county_code", F.col("found_name").alias("program_name")).distinct().withColumn("good", F.lit(1))
    returned = shown.join(good, ["county_code", "program_name"], "left").groupBy("county_code").agg(F.count("*").alias("n_returned"), F.count("good").alias("good"))
    recalled = pairs.groupBy("county_code").agg(F.countDistinct("gold_name").alias("recalled"))
    out = n_gold.join(returned, "county_code", "left").join(recalled, "county_code", "left").fillna(0, ["n_returned", "good", "recalled"])
    return out.select("county_code", "n_gold", "n_returned", F.round(F.col("recalled") / F.col("n_gold"), 6).alias("answer_recall"), F.round(E.ratio(F.col("good"), F.col("n_returned")), 6).alias("answer_precision"))


_COUNTY = "trim(regexp_replace(regexp_replace(lower(trim({c})), '(^|\\s+)county$', ''), '^county of\\s+', ''))"


def _county(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(^|\s+)county$", ""), r"^county of\s+", ""))


_SIDES = f"""gc AS (SELECT DISTINCT county, k FROM (SELECT {_COUNTY.format(c='county_name')} AS county, unnest([translate(health_department_contact_phone, '-() ', ''), lower(health_department_contact_email)]) AS k FROM structured_counties WHERE {_GOLD}) WHERE k <> '' AND county IS NOT NULL),
    fc AS (SELECT DISTINCT county, k FROM (SELECT {_COUNTY.format(c='county')} AS county, unnest(list_concat(list_transform(coalesce(contacts.phones, []), lambda p: translate(p, '-() ', '')), list_transform(coalesce(contacts.emails, []), lambda e: lower(e)))) AS k FROM raw_pages) WHERE county IS NOT NULL)"""


def _pr_sql(name: str, g: str, f: str) -> str:
    return f"""{name}_b AS (SELECT coalesce(g.county, f.county) AS county, g.k IS NOT NULL AS ig, f.k IS NOT NULL AS inf FROM {g} g FULL JOIN {f} f ON g.county = f.county AND g.k = f.k),
    {name}_c AS (SELECT county, count(*) FILTER (WHERE ig AND inf) AS tp, count(*) FILTER (WHERE inf AND NOT ig) AS fp, count(*) FILTER (WHERE ig AND NOT inf) AS fn FROM {name}_b GROUP BY 1),
    {name} AS (SELECT county, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM {name}_c WHERE county IN (SELECT county FROM {g}))"""


def _contact_scores(t):
    phone, mail = T.phone_key(F.col("health_department_contact_phone")), F.lower("health_department_contact_email")
    gold = t.structured_counties.where(_GOLD).select(_county("county_name").alias("county"), F.explode(F.array(phone, mail)).alias("k")).where("k <> '' and county is not null")
    none = F.array().cast("array<string>")
    each = F.concat(F.transform(F.coalesce("contacts.phones", none), lambda p: F.translate(p, "-() ", "")), F.transform(F.coalesce("contacts.emails", none), lambda e: F.lower(e)))
    found = t.raw_pages.where("county is not null").select(_county("county").alias("county"), F.explode(each).alias("k"))
    return E.precision_recall(gold, found, "county", "k").join(gold.select("county").distinct(), "county", "left_semi")


@query(f"WITH {_SIDES}, {_pr_sql('x', 'gc', 'fc')} SELECT * FROM x")
def evl2_contacts(spark, folder):
    """EVL2: contacts read from a county's pages against those set by hand."""
    return _contact_scores(Tables(spark, folder))


@query(f"""WITH gp AS (SELECT DISTINCT county, {_KEY.format(c='u')} AS k FROM (SELECT {_COUNTY.format(c='county')} AS county, unnest(pdf_links) AS u FROM raw_pages WHERE source_depth = 0) WHERE county IS NOT NULL),
    fp AS (SELECT DISTINCT county, {_KEY.format(c='u')} AS k FROM (SELECT {_COUNTY.format(c='county')} AS county, unnest(pdf_links) AS u FROM raw_pages WHERE source_depth > 0) WHERE county IS NOT NULL), {_pr_sql('x', 'gp', 'fp')} SELECT * FROM x""")
def evl2_pdfs(spark, folder):
    """EVL2: PDF links of a county's deeper pages against those of its seed pages."""
    own = Tables(spark, folder).raw_pages.where("county is not null").select(_county("county").alias("county"), "source_depth", F.explode("pdf_links").alias("u")).withColumn("k", T.url_key(F.col("u")))
    gold = own.where("source_depth = 0")
    return E.precision_recall(gold, own.where("source_depth > 0"), "county", "k").join(gold.select("county").distinct(), "county", "left_semi")


_MISSING = "(coalesce(eligibility_requirements IN ('Not specified', 'Not found', ''), true) OR coalesce(application_process IN ('Not specified', 'Not found', ''), true))"
_SAME = " + ".join(f"CASE WHEN lower(trim(coalesce(s.{c}, ''))) = lower(trim(coalesce(g.{c}, ''))) THEN 1 ELSE 0 END" for c in ("program_name", "eligibility_requirements", "application_process"))
_B_STRUCT = f"""sg AS (SELECT * FROM structured_programs WHERE {_GOLD}), ss AS (SELECT * FROM structured_programs WHERE NOT {_GOLD}), gu AS (SELECT * FROM sg WHERE record_id IN (SELECT max(record_id) FROM sg WHERE program_website_url IS NOT NULL GROUP BY {_KEY.format(c='program_website_url')}, county_code)),
    em AS (SELECT s.county_code, avg(({_SAME}) / 3.0) AS em FROM ss s JOIN gu g ON g.county_code = s.county_code AND {_KEY.format(c='g.program_website_url')} = {_KEY.format(c='s.program_website_url')} GROUP BY 1),
    st AS (SELECT county_code, avg(CASE WHEN {_MISSING} THEN 1.0 ELSE 0 END) AS missing FROM ss GROUP BY 1),
    p3 AS (SELECT c.county_code, CASE WHEN st.county_code IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS validity, round(coalesce(missing, 1.0), 6)::DOUBLE AS missing_rate, round(coalesce(em, 0.0), 6)::DOUBLE AS exact_match FROM (SELECT DISTINCT county_code FROM sg) c LEFT JOIN st USING (county_code) LEFT JOIN em USING (county_code))"""


def _structuring(t):
    programs = t.structured_programs.withColumn("k", T.url_key(F.col("program_website_url")))
    gold, found = programs.where(_GOLD), programs.where(f"not ({_GOLD})")
    fields = ("program_name", "eligibility_requirements", "application_process")
    last = gold.where("k is not null").groupBy("county_code", "k").agg(F.max_by(F.struct(*fields), "record_id").alias("g"))
    same = sum(((F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == F.lower(F.trim(F.coalesce(F.col(f"g.{c}"), F.lit(""))))).cast("int") for c in fields), F.lit(0)) / 3.0
    exact = found.join(last, ["county_code", "k"]).groupBy("county_code").agg(F.avg(same).alias("em"))
    missing = (G.is_critical_missing(F.col("eligibility_requirements")) | G.is_critical_missing(F.col("application_process"))).cast("double")
    own = found.groupBy("county_code").agg(F.avg(missing).alias("missing"), F.lit(1.0).alias("valid"))
    out = gold.select("county_code").distinct().join(own, "county_code", "left").join(exact, "county_code", "left")
    return out.select("county_code", F.coalesce("valid", F.lit(0.0)).alias("validity"), F.round(F.coalesce("missing", F.lit(1.0)), 6).alias("missing_rate"), F.round(F.coalesce("em", F.lit(0.0)), 6).alias("exact_match"))


@query(f"WITH {_B_STRUCT} SELECT * FROM p3")
def evl3_structuring(spark, folder):
    """EVL3, JON9: validity, missing rate, exact matches by normalised URL (the last gold of a URL counts); defaults for
    counties without programs."""
    return _structuring(Tables(spark, folder))


_RUN = f"""{_SIDES}, {_pr_sql('x', 'gc', 'fc')}, {_B_STRUCT}, gk AS (SELECT DISTINCT county_code, {_KEY.format(c='program_website_url')} AS k FROM structured_programs WHERE {_GOLD} AND program_website_url IS NOT NULL),
    rk AS (SELECT county_code, {_KEY.format(c='url')} AS k, row_number() OVER (PARTITION BY county_code ORDER BY score DESC NULLS LAST, url NULLS LAST) AS rank FROM (SELECT county_code, unnest(programs).url AS url, unnest(programs).score AS score FROM discovery_results)),
    r20 AS (SELECT g.county_code, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM rk WHERE rk.county_code = g.county_code AND rk.k = g.k AND rank <= 20)) / count(*)::DOUBLE AS recall FROM gk g GROUP BY 1),
    nm AS (SELECT county_code, min({_COUNTY.format(c='county_name')}) AS county FROM structured_counties GROUP BY 1),
    ev AS (SELECT p3.county_code, coalesce(round(r20.recall, 6), 0.0) AS recall_at_20, coalesce(x.precision, 0.0) AS contact_precision, coalesce(x.recall, 0.0) AS contact_recall, validity, missing_rate, exact_match
        FROM p3 JOIN (SELECT DISTINCT county_code FROM discovery_results) d USING (county_code) LEFT JOIN r20 USING (county_code) LEFT JOIN nm USING (county_code) LEFT JOIN x ON x.county = nm.county)"""


def _run(t):
    gold = t.structured_programs.where(_GOLD).where("program_website_url is not null").select("county_code", T.url_key(F.col("program_website_url")).alias("k"))
    recall = E.recall_at(gold, _ranked(t), "county_code", "k", "rank", [20])
    names = t.structured_counties.groupBy("county_code").agg(F.min(_county("county_name")).alias("county"))
    contacts = _contact_scores(t).select("county", F.col("precision").alias("contact_precision"), F.col("recall").alias("contact_recall"))
    out = _structuring(t).join(t.discovery_results.select("county_code"), "county_code", "left_semi").join(recall, "county_code", "left").join(names, "county_code", "left").join(contacts, "county", "left")
    return out.fillna(0.0, ["recall_at_20", "contact_precision", "contact_recall"]).select("county_code", "recall_at_20", "contact_precision", "contact_recall", "validity", "missing_rate", "exact_match")


@query(f"WITH {_RUN} SELECT * FROM ev")
def evl4_counties(spark, folder):
    """EVL4: all measures of each gold county that discovery has; missing parts have defaults."""
    return _run(Tables(spark, folder))


_FIVE = ("recall_at_20", "contact_precision", "contact_recall", "validity", "missing_rate")


@query(f"WITH {_RUN} SELECT count(*) AS counties, {', '.join(f'{_mean_sql(c)} AS {c}' for c in _FIVE)} FROM ev")
def agg18_averages(spark, folder):
    """AGG18: the five averages of an evaluation run."""
    return _run(Tables(spark, folder)).agg(F.count("*").alias("counties"), *[_mean(c).alias(c) for c in _FIVE])


@query(f"""WITH n AS (SELECT county_code, {_COUNTY.format(c='county_name')} AS name, count(*) AS n FROM structured_counties WHERE trim(county_name) <> '' GROUP BY 1, 2), d AS (SELECT county_code, arg_min(name, lpad((1000000 - n)::VARCHAR, 8, '0') || name) AS got FROM n GROUP BY 1)
    SELECT count(*) AS n_total, count(*) FILTER (WHERE got = {_COUNTY.format(c='county_name')}) AS n_correct, round(count(*) FILTER (WHERE got = {_COUNTY.format(c='county_name')}) / count(*)::DOUBLE, 6) AS accuracy FROM structured_programs LEFT JOIN d USING (county_code) WHERE trim(county_name) <> ''""")
def evl10_place_accuracy(spark, folder):
    """EVL10: the place looked up by its code (its most frequent name) against the place that a record names."""
    t = Tables(spark, folder)
    names = t.structured_counties.where(F.trim("county_name") != "").groupBy("county_code", _county("county_name").alias("name")).agg(F.count("*").alias("n"))
    places = argmax(names, ["county_code"], F.col("n"), F.col("name"), ["name"])
    same = F.coalesce(F.col("name") == _county("county_name"), F.lit(False))
    return t.structured_programs.where(F.trim("county_name") != "").join(places, "county_code", "left").agg(F.count("*").alias("n_total"), F.count_if(same).alias("n_correct"), F.round(F.count_if(same) / F.count("*"), 6).alias("accuracy"))


@query("""WITH p AS (SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(trim(text)) < 80 THEN 'too short' WHEN contacts IS NULL THEN 'no contacts' ELSE 'read' END AS why FROM raw_pages)
    SELECT why, count(*) AS pages, round(count(*) / (SELECT count(*) FROM raw_pages)::DOUBLE, 6) AS rate FROM p GROUP BY 1""")
def evl13_rates(spark, folder):
    """EVL13: pages read, and those left out by reason, with their rates."""
    t = Tables(spark, folder).raw_pages
    why = F.when(F.col("text").isNull(), "no text").when(F.length(F.trim("text")) < 80, "too short").when(F.col("contacts").isNull(), "no contacts").otherwise("read")
    total = t.agg(F.count("*").alias("total"))
    return t.groupBy(why.alias("why")).agg(F.count("*").alias("pages")).crossJoin(F.broadcast(total)).select("why", "pages", F.round(F.col("pages") / F.col("total"), 6).alias("rate"))


_PROGRAMS = [f"PRG{i:02}" for i in range(1, 37)]


@query(f"WITH {_MATCH} SELECT county_code, " + ", ".join(f"count(*) FILTER (WHERE m.program_id = '{p}') > 0 AS {p}" for p in _PROGRAMS) + " FROM structured_programs JOIN m USING (record_id) WHERE m.program_id IS NOT NULL GROUP BY 1")
def evl14_matrix(spark, folder):
    """EVL14: counties by programs, whether any record of the county is matched to the program."""
    m = _matched(spark, folder).where("program_id is not null").select(F.col("id").alias("record_id"), "program_id")
    own = Tables(spark, folder).structured_programs.select("record_id", "county_code").join(m, "record_id")
    wide = own.groupBy("county_code").pivot("program_id", _PROGRAMS).agg(F.count(F.lit(1)))
    return wide.select("county_code", *[(F.coalesce(F.col(p), F.lit(0)) > 0).alias(p) for p in _PROGRAMS])


@query("SELECT result_id, county_code, discovery_tier FROM discovery_results WHERE programs IS NULL OR len(programs) = 0")
def agg1_zero_results(spark, folder):
    return Tables(spark, folder).discovery_results.where(F.coalesce(F.size("programs"), F.lit(0)) <= 0).select("result_id", "county_code", "discovery_tier")


@query("SELECT county_code, 'missing' AS side FROM (SELECT DISTINCT county_code FROM structured_counties) WHERE county_code NOT IN (SELECT county_code FROM discovery_results WHERE county_code IS NOT NULL) UNION ALL SELECT county_code, 'extra' FROM (SELECT DISTINCT county_code FROM discovery_results) WHERE county_code NOT IN (SELECT county_code FROM structured_counties WHERE county_code IS NOT NULL)")
def jon14_both_sides(spark, folder):
    """JON14: counties expected but not discovered, and discovered but not expected."""
    t = Tables(spark, folder)
    a, b = t.structured_counties.select("county_code").distinct(), t.discovery_results.select("county_code").distinct()
    return a.join(b, "county_code", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "county_code", "left_anti").withColumn("side", F.lit("extra")))


@query("""WITH a AS (SELECT county_code, program_name AS name, 'table' AS source FROM structured_programs WHERE data_version = 'v5' AND program_name IS NOT NULL), b AS (SELECT county_code, p.name AS name, 'retrieved' AS source FROM (SELECT county_code, unnest(programs) AS p FROM discovery_results) WHERE p.name IS NOT NULL)
    SELECT DISTINCT * FROM a UNION SELECT DISTINCT * FROM b WHERE county_code NOT IN (SELECT county_code FROM a)
    UNION SELECT county_code, NULL, 'empty' FROM structured_counties WHERE county_code NOT IN (SELECT county_code FROM a) AND county_code NOT IN (SELECT county_code FROM b)""")
def jon20_source_priority(spark, folder):
    """JON20: names of the latest table; for counties without, those retrieved; for counties without either, an empty row."""
    from millrace.operators.links import else_from

    t = Tables(spark, folder)
    a = t.structured_programs.where("data_version = 'v5' and program_name is not null").select("county_code", F.col("program_name").alias("name"), F.lit("table").alias("source")).distinct()
    b = t.discovery_results.select("county_code", F.explode("programs").alias("p")).where("p.name is not null").select("county_code", "p.name", F.lit("retrieved").alias("source")).distinct()
    empty = t.structured_counties.select("county_code", F.lit(None).cast("string").alias("name"), F.lit("empty").alias("source")).distinct()
    return else_from(else_from(a, b, "county_code"), empty, "county_code")


@query("SELECT county, rank FROM (SELECT county, row_number() OVER (ORDER BY county) AS rank FROM (SELECT DISTINCT trim(county) AS county FROM raw_pages WHERE trim(county) <> ''))")
def top6_sorted_counties(spark, folder):
    """TOP6: the counties in order, with their places. The rows are those of a small dimension."""
    from pyspark.sql import Window as W

    names = Tables(spark, folder).raw_pages.select(F.trim("county").alias("county")).where("county <> ''").distinct()
    return names.select("county", F.row_number().over(W.orderBy("county")).cast("long").alias("rank")).orderBy("county")
