"""The same entries whatever the size of a shard; short names, exchanged letters and abbreviations in every reading."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import canon

NAMES = "entry_id string, name string, is_acronym boolean"


def found(spark, names, values, **kw):
    ref = spark.createDataFrame([(e, n, False) for e, n in names], NAMES)
    df = spark.createDataFrame(list(enumerate(values)), "record_id long, field string")
    return {values[r["record_id"]]: r["entry_id"] for r in canon.map_values(df, {"field": ref}, **kw).collect()}


@pytest.mark.parametrize("n", [1, 2, 100])
def test_ties_do_not_depend_on_shards(spark, n):
    assert found(spark, [("E9", "alpha kite center"), ("E1", "alpha mite center")], ["alpha lite center"], shard_names=n) == {"alpha lite center": "E9"}


def test_shards_of_any_size_agree(spark):
    r = random.Random(5)
    parts = ["home", "health", "care", "visiting", "center", "family", "county", "infant", "doula", "food"]
    names = [(f"E{i:03}", " ".join(r.sample(parts, r.randrange(1, 4)))) for i in range(24)]
    values = []
    for _, n in names:
        k = r.randrange(len(n))
        values += [n, n[:k] + n[k + 1 :], n.upper().replace("CENTER", "Ctr."), n[1:2] + n[:1] + n[2:], n + " x", n.replace("health", "hlth"), n[::-1]]
    got = [found(spark, names, values, shard_names=k) for k in (1000, 9, 4)]
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) > 15


def test_short_names(spark):
    values = ["caro", "acre", "cxyz", "wix", "wic"]
    assert found(spark, [("E1", "care"), ("E2", "wic")], values) == {"caro": "E1", "acre": "E1", "cxyz": "UNMATCHED", "wix": "UNMATCHED", "wic": "E2"}


def test_exchanged_letters_and_abbreviations(spark):
    names = [("E1", "high risk pregnancy care"), ("E2", "oral health")]
    values = ["High-Rsik Preg. Care", "Care, High Risk Pregnancy", "orla helath", "Hgh Rsk Prgnncy Care", "(new) - Oral Hlth"]
    assert found(spark, names, values) == dict(zip(values, ["E1", "E1", "E2", "E1", "E2"]))


def test_letters_bound_the_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcdeé ") for _ in range(r.randrange(0, 14))) for _ in range(2))
        both = canon._letters(a) & canon._letters(b)
        assert max((canon._letters(a) ^ both).bit_count(), (canon._letters(b) ^ both).bit_count()) <= canon.distance(a, b)


def test_a_large_reference_list(spark):
    """Several shards of the usual size; one value typed in most rows is looked up once."""
    words = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "jo", "ki", "lu", "me") for b in ("ran", "sel", "tor", "vin", "wat", "xen", "yor", "zam", "pel", "nor")]
    n = 60_000
    at = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("id") / k, F.lit(100)).cast("int") + 1))
    ref = spark.range(n).select(F.format_string("E%06d", "id").alias("entry_id"), F.concat_ws(" ", at(1), at(100), F.format_string("%d", F.expr("id div 10000")), F.lit("clinic")).alias("name"), F.lit(False).alias("is_acronym"))
    some = {r["name"]: r["entry_id"] for r in ref.where("id % 17011 = 0").collect()}
    values = [*some, *(x[:3] + x[4:] for x in some), "nothing like these at all"]
    df = spark.createDataFrame([(i, values[i] if i < len(values) else values[0]) for i in range(3000)], "record_id long, field string")
    got = {r["field"]: r["entry_id"] for r in canon.map_values(df, {"field": ref}).join(df, "record_id").select("field", "entry_id").distinct().collect()}
    assert {v: got[v] for v in some} == some and got[values[-1]] == "UNMATCHED" and "UNMATCHED" not in {got[v] for v in values[:-1]}
