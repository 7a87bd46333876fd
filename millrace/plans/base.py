"""What the query modules share: tables, dictionaries, a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def aliases(self) -> DataFrame:
        """alias: aliases of programs and other spellings of categories, in lower case."""
        both = self.program_registry.select(F.explode("county_aliases").alias("a")).union(self.category_list.select(F.explode("also_written").alias("a")))
        return both.select(F.trim(F.lower("a")).alias("alias")).distinct()

    def keywords(self) -> DataFrame:
        """word: other spellings of categories, in lower case."""
        return self.category_list.select(F.explode("also_written").alias("w")).select(F.trim(F.lower("w")).alias("word")).distinct()


ALIAS_SQL = "alias AS (SELECT DISTINCT trim(lower(a)) AS alias FROM (SELECT unnest(county_aliases) AS a FROM program_registry UNION ALL SELECT unnest(also_written) FROM category_list))"
KEYWORD_SQL = "keyword AS (SELECT DISTINCT trim(lower(w)) AS word FROM (SELECT unnest(also_written) AS w FROM category_list))"


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def host_sql(c: str) -> str:
    return f"regexp_extract(lower({c}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"


def path_sql(c: str) -> str:
    return f"regexp_extract(lower({c}), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def parts_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({path_sql(c)}, '[/\\-_.]'), lambda x: x <> '')"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def name_sql(c: str) -> str:
    return collapse_sql(f"translate(lower({c}), {PUNCT_SQL}, '')")
