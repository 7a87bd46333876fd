"""What the operators of this subpackage share: words, Arrow batches, bounded broadcasts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import ship

#: A maximal run of Unicode letters and digits (categories L and N): what \\w has, less the underscore.
WORD = re.compile(r"[^\W_]+")
#: Stand-ins for a missing value, trimmed and lower-cased (fixed values of TESTDATA.md, problem 5).
STAND_INS = ("not found", "not specified", "n/a", "none", "unknown", "tbd", "-")


def words(text: str) -> list[str]:
    found = WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df through fn, an Arrow batch at a time."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


def usable(c) -> F.col:
    """The trimmed value, or null if it is null, blank or a stand-in."""
    t = F.btrim(c, F.lit(" \t\r\n\u00a0"))
    return F.when((t != "") & ~F.lower(t).isin(*STAND_INS), t)


def county_key(c) -> F.col:
    """County trimmed and lower-cased, without a final word "county"; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"(^|\s+)county$", ""))
