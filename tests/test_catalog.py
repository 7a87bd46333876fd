"""Every query of the core with SQL gives the same rows as DuckDB; the others give rows."""

import pytest
from conftest import same_rows

from millrace.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, folder, name):
    same_rows(catalog.queries()[name](spark, folder), catalog.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, folder, name):
    assert catalog.queries()[name](spark, folder).count() > 0


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_nothing_but_the_entry_imports_the_subpackage():
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for at, _, files in os.walk(os.path.join(root, "millrace")):
        if os.path.basename(at) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(at, f), encoding="utf-8") as x:
                        assert not re.search(r"(from|import) millrace\.llm|from millrace import .*\bllm\b", x.read()), f
