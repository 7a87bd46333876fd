"""Every dealt query over the smallest tables: the columns asked for, distinct rows, the same rows as SQL where there is SQL."""

import pytest
from conftest import same_rows

from millrace.llm import queries as Q
from millrace.llm import sql as S

COLUMNS = {
    "p1_found": "page_id cut", "p2_found": "page_id_a page_id_b", "p3_found": "page_id line_no", "p4_found": "page_id line_no", "p5_found": "group_key field_name record_id",
    "p6_found": "page_id", "p7_found": "record_id field_name entry_id", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id kind char_pos",
}


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, folder, name):
    df = Q.queries()[name](spark, folder)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    if name in S.oracle_sql():
        same_rows(df, S.oracle_sql()[name], folder)
    else:
        rows = df.collect()
        assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))


def test_every_problem_has_its_query():
    assert set(COLUMNS) <= set(Q.queries()) and set(S.oracle_sql()) <= set(Q.queries())
