"""The same results in SQL, for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w))"
_STAND_INS = "('not found', 'not specified', 'n/a', 'none', 'unknown', 'tbd', '-')"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def _usable(c: str) -> str:
    t = _TRIM.format(c)
    return f"(CASE WHEN {t} <> '' AND lower({t}) NOT IN {_STAND_INS} THEN {t} END)"


_DAY = r"""coalesce(
    try_strptime(regexp_extract(trim(last_updated), '^(\d{4}-\d{1,2}-\d{1,2})([T ].*)?$', 1), '%Y-%m-%d'),
    try_strptime(regexp_extract(trim(last_updated), '^\d{1,2}/\d{1,2}/\d{4}$'), '%m/%d/%Y'),
    try_strptime(trim(last_updated), '%B %d, %Y'), try_strptime(trim(last_updated), '%b %d, %Y'))::DATE"""
_EMAIL = f"CASE WHEN regexp_matches({_usable('health_department_contact_email')}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN {_usable('health_department_contact_email')} END"
_PHONE = f"CASE WHEN length(regexp_replace({_usable('health_department_contact_phone')}, '[^0-9]', '', 'g')) >= 10 THEN {_usable('health_department_contact_phone')} END"
_TEXT = f"CASE WHEN NOT regexp_matches({_usable('eligibility_requirements')}, '(\\.\\.\\.|…)$') THEN {_usable('eligibility_requirements')} END"


def _p5(columns: str) -> str:
    branches = [("structured_counties", "county_code", "health_department_contact_email", _EMAIL), ("structured_counties", "county_code", "health_department_contact_phone", _PHONE), ("structured_programs", "program_uid", "eligibility_requirements", _TEXT)]
    rows = " UNION ALL ".join(f"SELECT {k} AS group_key, '{f}' AS field_name, record_id, source_trust, {_DAY} AS day, {v} AS value, count(*) OVER (PARTITION BY {k}) AS n FROM {t} WHERE {k} IS NOT NULL" for t, k, f, v in branches)
    return f"""WITH r AS ({rows}), s AS (SELECT *, row_number() OVER (PARTITION BY group_key, field_name
        ORDER BY source_trust DESC NULLS LAST, day DESC NULLS LAST, record_id) AS rn FROM r WHERE value IS NOT NULL AND n >= 2)
        SELECT {columns}"""


_P3 = r"""WITH pages AS (SELECT page_id, text, trim(regexp_replace(lower(trim(county)), '(^|\s+)county$', '')) AS source FROM raw_pages WHERE county IS NOT NULL),
    sizes AS (SELECT source, count(*) AS docs FROM pages GROUP BY source),
    parts AS (SELECT page_id, source, string_split(text, chr(10)) AS l FROM pages),
    lines AS (SELECT page_id, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM parts),
    normal AS (SELECT page_id, source, line_no, regexp_replace(lower(trim(regexp_replace(line, '[ \t\r\x{A0}]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM lines),
    hot AS (SELECT n.source, line FROM normal n JOIN sizes USING (source) WHERE line <> '' GROUP BY n.source, line, docs
        HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) * 100 >= docs * 15)"""

_P9 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda p: array_to_string(w[p:p+9], ' '))) AS g FROM d),
    ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda p: array_to_string(w[p:p+9], ' '))) AS g FROM i),
    found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""


def _p2(size: int, share: float) -> str:
    grams = " || ' ' || ".join(f"w[p + {i}]" if i else "w[p]" for i in range(size))
    return f"""WITH d AS (SELECT page_id, {_WORDS} AS w FROM raw_pages), e AS (SELECT * FROM d WHERE len(w) >= 60),
        g AS (SELECT page_id, unnest(list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda p: {grams}))) AS g FROM e),
        n AS (SELECT page_id, count(*) AS n FROM g GROUP BY page_id),
        c AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.page_id < b.page_id GROUP BY 1, 2),
        pairs AS (SELECT a, b FROM c JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE common >= {share} * (x.n + y.n - common) - 1e-9)"""


def _groups(size: int, share: float) -> str:
    """Members, classes of equal sets, links between classes, and the smallest class that links lead to."""
    return _p2(size, share).replace("pairs AS (", "raw AS (").rstrip() + f""", s AS (SELECT page_id, list_sort(list(g)) AS s FROM g GROUP BY 1), m AS (SELECT page_id, min(page_id) OVER (PARTITION BY s) AS class FROM s),
        l AS (SELECT DISTINCT x.class AS a, y.class AS b FROM raw JOIN m x ON x.page_id = a JOIN m y ON y.page_id = b WHERE x.class <> y.class),
        ab AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM l), edge AS (SELECT DISTINCT a, b FROM ab UNION SELECT DISTINCT b, a FROM ab),
        reach AS (SELECT DISTINCT class AS u, class AS v FROM m UNION SELECT r.u, e.b FROM reach r JOIN edge e ON e.a = r.v)
        SELECT page_id, class, (SELECT min(v) FROM reach WHERE u = class) AS near_class, (SELECT count(*) FROM edge WHERE a = class) AS n_links FROM m"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""SELECT page_id, CASE WHEN regexp_matches(text, '[^ \t\n\x{A0}\x{3000}\x{3002}]{801,}') THEN 'forced' ELSE 'natural' END AS cut FROM raw_pages WHERE length(text) > 800""",
        "p1_restored": "SELECT page_id, md5(text) AS md5, true AS within, true AS overlapping, true AS at_boundaries FROM raw_pages WHERE length(text) > 800",
        "p2_found": _p2(3, 0.7) + " SELECT a AS page_id_a, b AS page_id_b FROM pairs",
        "p2_groups": _groups(3, 0.7).replace("WITH d AS", "WITH RECURSIVE d AS", 1),
        "p2_groups_five": _groups(5, 0.8).replace("WITH d AS", "WITH RECURSIVE d AS", 1),
        "p2_links": _groups(3, 0.7).split(", edge AS (SELECT DISTINCT")[0] + """, z AS (SELECT DISTINCT x.class AS c, n.n FROM m x JOIN n USING (page_id))
            SELECT b.a AS class_a, b.b AS class_b, round(common / (x.n + y.n - common), 6) AS similarity FROM (SELECT DISTINCT a, b FROM ab) b JOIN z x ON x.c = b.a JOIN z y ON y.c = b.b
            JOIN c ON c.a = b.a AND c.b = b.b""",
        "p3_found": _P3 + " SELECT page_id, line_no FROM normal JOIN hot USING (source, line)",
        "p3_clean": _P3 + """, gone AS (SELECT page_id, list(line_no) AS gone FROM normal JOIN hot USING (source, line) GROUP BY page_id)
            SELECT page_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
            FROM raw_pages LEFT JOIN gone USING (page_id)""",
        "p5_found": _p5("group_key, field_name, record_id FROM s WHERE rn = 1"),
        "p5_records": _p5(", ".join(["group_key", *(f"max(CASE WHEN field_name = '{n}' THEN value END) AS {n}" for n in ("health_department_contact_email", "health_department_contact_phone", "eligibility_requirements"))]) + " FROM s WHERE rn = 1 GROUP BY group_key"),
        "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
        "p9_found": _P9 + " SELECT doc_id, item_id FROM found",
        "p9_items": _P9 + " SELECT item_id, count(*) AS documents FROM found GROUP BY item_id",
    }
