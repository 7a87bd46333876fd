"""A conversation as a fold over its ordered turns: ask for a place, confirm it, show what there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_turns(turns: DataFrame, counties: list[str]) -> DataFrame:
    """conversation, step, county, n_turns from turns (conversation, turn, text). A turn that names a county (the first
    of the list that it holds) leads from ask to confirm, "yes" from there to show, "no" back to ask, anything in show
    to done. All turns of a conversation are one row's array, as a person types few."""
    named = F.lit(None).cast("string")
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    for c in reversed(counties):
        named = F.when(low.contains(c.lower()), F.lit(c)).otherwise(named)
    said = F.struct("turn", named.alias("county"), low.rlike(r"^\s*(yes|y|ok|correct)\b").alias("yes"), low.rlike(r"^\s*(no|n|wrong)\b").alias("no"))
    ordered = turns.groupBy("conversation").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    start = F.struct(F.lit("ask").alias("step"), F.lit(None).cast("string").alias("county"))

    def step(state: Column, t: Column) -> Column:
        s = state["step"]
        to = (
            F.when((s == "ask") & t["county"].isNotNull(), "confirm")
            .when((s == "confirm") & t["yes"], "show")
            .when((s == "confirm") & t["county"].isNotNull(), "confirm")
            .when((s == "confirm") & t["no"], "ask")
            .when((s == "show") | (s == "done"), "done")
            .otherwise(s)
        )
        county = F.when((s == "ask") | (s == "confirm"), F.when((s == "confirm") & t["no"] & t["county"].isNull(), F.lit(None)).otherwise(F.coalesce(t["county"], state["county"]))).otherwise(state["county"])
        return F.struct(to.alias("step"), county.alias("county"))

    folded = F.aggregate("turns", start, step)
    return ordered.select("conversation", folded["step"].alias("step"), folded["county"].alias("county"), F.size("turns").alias("n_turns"))
