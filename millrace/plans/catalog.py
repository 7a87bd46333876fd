"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.gates import INDICATORS, page_gate
from millrace.plans import discover, evals, match, more, scan, suites  # noqa: F401
from millrace.plans.base import ALIAS_SQL, QUERIES, SQL, Tables, collapse_sql, sql_list
from millrace.runtime import spread


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through the content gate, first of each fingerprint, contacts extracted, counted by county."""
    t = Tables(spark, folder)
    gated = page_gate(spread(t.raw_pages.select("page_id", "county", "text"), "page_id"), t.aliases()).select("page_id", "county", "is_program_page", T.fingerprint(F.col("text")).alias("fp"), T.phones(F.col("text")).alias("phones"))
    first = gated.groupBy("fp").agg(F.min_by(F.struct("county", "is_program_page", "phones"), "page_id").alias("p")).select("p.*")
    return first.groupBy("county").agg(F.count("*").alias("pages"), F.count_if("is_program_page").alias("program_pages"), F.sum(F.size("phones")).alias("phones"))


_FLAGSHIP = f"""WITH {ALIAS_SQL}, p AS (SELECT page_id, county, lower(coalesce(text, '')) AS low, sha1(lower({collapse_sql('substr(text, 1, 2000)')})) AS fp,
    len(list_distinct(regexp_extract_all(text, '\\(?[0-9]{{3}}\\)?[-. \\t\\n\\r\\f\\v]?[0-9]{{3}}[-. \\t\\n\\r\\f\\v]?[0-9]{{4}}'))) AS n FROM raw_pages),
    f AS (SELECT county, n, length(low) >= 200 AND ((SELECT count(*) FROM alias WHERE contains(low, alias)) > 0 OR len(list_filter({sql_list(INDICATORS)}, lambda w: contains(low, w))) >= 3) AS good
        FROM p WHERE page_id IN (SELECT min(page_id) FROM p GROUP BY fp))
    SELECT county, count(*) AS pages, count(*) FILTER (WHERE good) AS program_pages, sum(n)::BIGINT AS phones FROM f GROUP BY county"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"flagship": _FLAGSHIP, **SQL}
