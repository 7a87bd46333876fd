"""The edge to services that are not part of the engine: a callable is given in, a rule-based one is the default."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import ship

REPLY = "program_name string, eligibility string, application string, contact string"


def rule_completion(prompt: str) -> str:
    """A reply in JSON without any model: the first line as the name, the first sentences that speak of eligibility, of
    applying and of a contact."""
    lines = [x.strip() for x in prompt.split("\n") if x.strip()]
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", prompt) if s.strip()]
    first = lambda p: next((s for s in sentences if re.search(p, s, re.I)), "Not specified")
    return "```json\n" + json.dumps({"program_name": lines[0] if lines else "Not found", "eligibility": first(r"qualify|eligib|requirement"), "application": first(r"apply|sign up|enroll"), "contact": first(r"\d{3}[-. ]\d{4}|@")}) + "\n```"


def complete(df: DataFrame, id_col: str, prompt_col: str, call: Callable[[str], str] = rule_completion) -> DataFrame:
    """id, reply: what `call` says to each prompt; null for a null prompt or if the call fails, so that one bad record
    does not end the job. Rate limits are the callable's own."""
    ship(df.sparkSession)

    def one(p: str | None) -> str | None:
        try:
            return None if p is None else call(p)
        except Exception:
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "reply": [one(x if isinstance(x, str) else None) for x in p["prompt"]]})

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(prompt_col).alias("prompt"))
    return own.mapInPandas(run, "id long, reply string")


def parse_reply(replies: DataFrame, schema: str = REPLY) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejects): JSON with or without fences; what can't be parsed is kept apart."""
    body = F.regexp_replace(F.trim("reply"), r"^```(?:json)?\s*|\s*```$", "")
    parsed = replies.withColumn("r", F.from_json(body, schema)).withColumn("ok", F.col("r").isNotNull() & F.coalesce(F.trim(body).startswith("{"), F.lit(False)))
    return parsed.where("ok").select("id", "r.*"), parsed.where("not ok").select("id", "reply")
