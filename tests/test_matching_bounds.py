"""Dictionaries of any size give the same rows: in one block, in many, and with the automaton of plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates as G
from millrace.operators import matching as M
from millrace.operators.terms import Automaton, held_terms

N = 5_000


@pytest.fixture(scope="module")
def large(spark):
    """Aliases "alias 00000 b" to "alias 04999 b" of programs P0 to P9, and texts with some of them."""
    aliases = spark.range(N).select(F.format_string("%05d", "id").alias("ord"), F.format_string("alias %05d b", "id").alias("alias"), F.concat(F.lit("P"), (F.col("id") % 10).cast("string")).alias("program_id")).persist()
    rows = [(1, f"has Alias {N - 1:05d} b here, and alias 00017 b"), (2, "b 00042 then alias"), (3, None), (4, "nothing"), (5, "")]
    return spark.createDataFrame(rows, "id long, text string"), aliases


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_match_registry(spark, large, block):
    df, aliases = large
    registry = spark.createDataFrame([("P7", "nothing more")], "program_id string, canonical_name string")
    got = {r["id"]: (r["program_id"], r["confidence"]) for r in M.match_registry(df, aliases, registry, "id", F.col("text"), block).collect()}
    assert got == {1: ("P7", 1.0), 2: ("P2", 0.8), 3: (None, 0.0), 4: (None, 0.0), 5: (None, 0.0)}


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_exact_contained_named_classified(spark, large, block):
    _, aliases = large
    df = spark.createDataFrame([(1, "Alias 00100 B"), (2, "00033 b"), (3, "our alias 04000 b too"), (4, ""), (5, None)], "id long, text string")
    got = {r["id"]: r["program_id"] for r in M.exact_then_contained(df, aliases, "id", F.col("text"), block).collect()}
    assert got == {1: "P0", 2: "P3", 3: "P0", 4: None, 5: None}
    names = aliases.select(F.initcap("alias").alias("name"))
    assert {tuple(r) for r in M.first_named(df, names, "id", F.col("text"), block).collect()} == {(1, "Alias 00100 B"), (3, "Alias 04000 B")}
    words = aliases.select(F.col("program_id").alias("type"), F.col("alias").alias("word"), F.lit(2).alias("weight"))
    got = {r["id"]: (r["type"], r["score"]) for r in M.classify_by(df, words, "id", F.lower("text"), block).collect()}
    assert got == {1: ("P0", 2.0), 2: (None, 0.0), 3: ("P0", 2.0), 4: (None, 0.0), 5: (None, 0.0)}


def test_page_gate_with_a_table(spark, large):
    df, aliases = large
    pages = df.select("id", F.concat_ws(" ", "text", F.lit("x" * 200)).alias("text"))
    got = {r["id"]: (r["score"], r["reason"]) for r in G.page_gate(pages, aliases.select("alias")).collect()}
    assert got[1] == (2, "program page") and got[2] == (0, "no registry signal")


def test_held_terms(spark):
    df = spark.createDataFrame([(1, "abcde", 7), (2, None, 7), (3, "xyz", 7)], "id long, t string, held_before int")
    terms = spark.createDataFrame([("abc",), ("c",), ("cde",), ("",), ("abc",)], "term string")
    for block in (100, 1):
        assert [(r["id"], r["held"]) for r in held_terms(df, F.col("t"), terms, "held", block).orderBy("id").collect()] == [(1, ["abc", "c", "cde"]), (2, []), (3, [])]
    assert held_terms(df, F.col("t"), terms.where("false")).where("size(held) > 0").count() == 0


def test_automaton_finds_what_a_scan_finds(monkeypatch):
    r = random.Random(4)
    for plain in (False, True):
        if plain:
            monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
        for _ in range(30):
            terms = list({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(12)})
            a = Automaton(terms)
            assert (a._compiled is None) == plain
            for _ in range(10):
                t = "".join(r.choice("abcd") for _ in range(r.randrange(0, 30)))
                assert {terms[i] for i in a.held(t)} == {x for x in terms if x in t}
