"""Problem 5: one surviving record for each group of records, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import usable


def calendar_day(c: Column) -> Column:
    """The day of a text such as 2025-06-17, 2025-06-17T22:00:00, 06/17/2025 or June 17, 2025; null if unreadable."""
    t = F.trim(c)
    iso = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})([T ].*)?$", 1), F.lit("yyyy-M-d"))
    slashed = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), F.lit("M/d/yyyy"))
    month = F.initcap(F.regexp_extract(t, r"^([A-Za-z]{3})[A-Za-z]*\.? +\d{1,2},? +\d{4}$", 1))
    rest = F.regexp_extract(t, r"^[A-Za-z]{3,9}\.? +(\d{1,2}),? +\d{4}$", 1)
    year = F.regexp_extract(t, r"^[A-Za-z]{3,9}\.? +\d{1,2},? +(\d{4})$", 1)
    named = F.try_to_timestamp(F.concat_ws(" ", month, rest, year), F.lit("MMM d yyyy"))
    return F.coalesce(iso, slashed, named).cast("date")


def usable_email(c: Column) -> Column:
    t = usable(c)
    return F.when(t.rlike("^[^@\\s\\u00a0\\u3000]+@[^@\\s\\u00a0\\u3000]+\\.[^@\\s\\u00a0\\u3000]+$"), t)


def usable_phone(c: Column) -> Column:
    t = usable(c)
    return F.when(F.length(F.regexp_replace(t, "[^0-9]", "")) >= 10, t)


def usable_text(c: Column) -> Column:
    t = usable(c)
    return F.when(~(t.endswith("...") | t.endswith("…")), t)


def survivors(df: DataFrame, key_col: str, fields: dict[str, Column], id_col: str = "record_id", trust_col: str = "source_trust", date_col: str = "last_updated") -> DataFrame:
    """group_key, field_name, record_id, value: for each key with at least two records and each field (name: column
    that is null where unusable), the value of the record with the greatest trust, then the latest day (none is the
    earliest), then the smallest id.

    One aggregation with the maximum of a composite struct per field, partly computed before the shuffle, so a key
    with a third of all rows costs no more than others. Null keys form no group; a null trust is the least. Rows
    repeated with one id count as one record. No row where no value is usable."""
    day = calendar_day(F.col(date_col))
    rank = [F.coalesce(F.col(trust_col), F.lit(-(2**31))).alias("trust"), F.coalesce(F.unix_date(day), F.lit(-(2**31))).alias("day"), (-F.col(id_col)).alias("id")]
    best = [F.max(F.when(c.isNotNull(), F.struct(*rank, c.alias("value")))).alias(f"f{i}") for i, c in enumerate(fields.values())]
    grouped = df.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("group_key")).agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"), *best).where("least < most")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(f"f{i}").alias("best")) for i, name in enumerate(fields)]))
    return grouped.select("group_key", each.alias("x")).where("x.best is not null").select("group_key", "x.field_name", (-F.col("x.best.id")).alias("record_id"), "x.best.value")
