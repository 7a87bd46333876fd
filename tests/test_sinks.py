"""Reports and versions written and read again, collections built once, binary files, settings, chunks, states."""

import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import collections as C
from millrace.operators import tfidf as I
from millrace.operators.links import name_matches
from millrace.sources import files, sinks


def test_versions_count_up(spark, tmp_path):
    df = spark.createDataFrame([("Kern", "P")], "County_Name string, Program_Name string")
    assert sinks.next_version(spark, str(tmp_path)) == 1
    for _ in range(2):
        sinks.write_versioned(df, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["v1", "v2"] and sinks.next_version(spark, str(tmp_path / "none")) == 1


def test_gap_report(spark, tmp_path):
    rows = [("a", "A Name", "P1", 0.7, 0.9, 3, 2, "likely alias"), ("b", "B", None, 0.0, 0.5, 1, 1, "new program"), ("c", "C", "P1", 0.3, 0.1, 1, 1, "new program")]
    df = spark.createDataFrame(rows, "norm_name string, extracted_name string, semantic_match string, semantic_score double, gap_score double, frequency long, n_counties long, label string")
    absence = spark.createDataFrame([("P1", " some text ", 0.8), ("P2", "other", 0.4)], "program_id string, matching_text string, score double")
    sinks.write_gap_report(df, absence, str(tmp_path), shown=2)
    assert spark.read.json(str(tmp_path / "gap_candidates")).count() == 3
    assert [(r["program_id"], r["names"]) for r in spark.read.json(str(tmp_path / "alias_suggestions")).collect()] == [("P1", ["A Name", "some text"])]
    text = (tmp_path / "gap_report.txt").read_text()
    assert text.splitlines()[1].startswith("[0.90] A Name") and "[0.10]" not in text and "P1: 1 pages" in text


def test_metrics_and_benchmarks(spark, tmp_path):
    run = sinks.run_id(datetime(2026, 1, 2, 3, 4, 5), "abcdef0123", {"k": 1})
    assert run.startswith("20260102_030405_abcdef0_") and len(run) == 32 and run == sinks.run_id(datetime(2026, 1, 2, 3, 4, 5), "abcdef0999", {"k": 1})
    counties = spark.createDataFrame([("c", 0.5)], "county string, recall double")
    sinks.write_metrics(counties, counties.agg(F.avg("recall").alias("recall")), str(tmp_path), run)
    assert json.loads((tmp_path / f"metrics_{run}.json").read_text()) == {"run_id": run, "aggregate_metrics": {"recall": 0.5}}
    assert spark.read.option("header", True).csv(str(tmp_path / f"metrics_{run}")).first()["recall"] == "0.5"
    sinks.write_benchmark({"b1": counties}, str(tmp_path), run)
    assert spark.read.json(str(tmp_path / run / "b1")).count() == 1


def test_discovery_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([("c", "u", "", "", [("n", "x", "t", "p", 1.0)], None), ("d", "u", "", "", [], None)], files.DISCOVERY.split("results array<struct<")[1][:-2])
    sinks.write_discovery(df.repartition(2), str(tmp_path / "d"), datetime(2026, 1, 1))
    assert sorted(r["county_name"] for r in files.read_discovery(spark, str(tmp_path / "d")).collect()) == ["c", "d"]


def test_collections_are_built_once(spark, tmp_path):
    at = str(tmp_path / "c")
    chunks = spark.createDataFrame([("county_a", "x"), ("county_a", "y"), ("county_b", "z")], "collection string, chunk string")
    status = lambda df: {r["collection"]: (r["chunks"], r["status"]) for r in df.collect()}
    assert status(C.build_collections(chunks.where("collection = 'county_a'"), at)) == {"county_a": (2, "built")}
    assert status(C.build_collections(chunks.withColumn("chunk", F.lit("new")), at)) == {"county_a": (2, "kept"), "county_b": (1, "built")}
    assert sorted((r["collection"], r["chunk"]) for r in spark.read.parquet(at).collect()) == [("county_a", "x"), ("county_a", "y"), ("county_b", "new")]
    assert status(C.build_collections(chunks.where("collection = 'county_a'").limit(1), at, force=True)) == {"county_a": (1, "built")}
    assert spark.read.parquet(at).where("collection = 'county_a'").count() == 1


def test_recursive_chunks(spark):
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(40)) + ". Next one." for i in range(12))
    pieces = C.split_recursive(text, 300, 50)
    assert all(len(p) <= 300 for p in pieces) and all(p in text for p in pieces) and set(re.findall(r"\w+", text)) == {w for p in pieces for w in re.findall(r"\w+", p)}
    assert C.split_recursive("x" * 1000, 300, 50)[0] == "x" * 300 and C.split_recursive("short") == ["short"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "tiny")], "id long, t string")
    got = C.recursive_chunks(df, "id", F.col("t"), 300, 50).orderBy("chunk_no").collect()
    assert {r["id"] for r in got} == {1} and [r["chunk_no"] for r in got] == list(range(len(got)))


def test_all_programs(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "California_Kern_Healthcare_Data.csv").write_text('Program_Name,Services,Program_Website_URL\n"A, b",x; y;;,u\n,z,u\n')
    (tmp_path / "combined.csv").write_text("program_name,services_provided,program_description\nB,,d\n")
    got = {(r["county"], r["name"], r["url"], r["description"], tuple(r["services"])) for r in files.read_all_programs(spark, str(tmp_path)).collect()}
    assert got == {("Kern", "A, b", "u", "", ("x", "y")), ("combined", "B", "", "d", ())}


def test_binary_documents_and_settings(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def extract(content, most):
        if content == b"bad":
            raise ValueError("no text")
        return content.decode() * most

    got = {r["path"][-5:]: (r["text"], r["error"]) for r in files.read_documents(spark, str(tmp_path), extract, most_pages=2).collect()}
    assert got == {"a.pdf": ("goodgood", None), "b.pdf": (None, "ValueError: no text")}
    (tmp_path / "s").write_text("# c\nA = 'x y'\nexport B=2\n\nC\n")
    assert files.read_settings(str(tmp_path / "s")) == {"A": "x y", "B": "2"}


def test_states_end(spark):
    df = spark.createDataFrame([(0,), (7,), (50,)], "n int").withColumn("state", F.lit(0))
    got = {r["n"]: (r["state"], r["steps"]) for r in C.run_states(df, F.when(F.col("state") < F.col("n"), F.col("state") + 1).otherwise(F.col("state"))).collect()}
    assert got == {0: (0, 0), 7: (7, 7), 50: (10, 10)}


def test_small_functions(spark):
    df = spark.createDataFrame([("93301-1234", '["a","b"]', "0.7"), ("9330", "x", "9"), (None, " ", "no")], "z string, l string, n string")
    got = [tuple(r) for r in df.select(T.zip_code(F.col("z")), T.list_or_scalar(F.col("l")), T.clamped(F.col("n"))).collect()]
    assert got == [("93301", ["a", "b"], 0.7), (None, ["x"], 1.0), (None, [], 0.0)]
    mail = spark.createDataFrame([("write to b@x.example, a@x.example or a@x.example.",)], "t string")
    assert mail.select(T.agent_emails(F.col("t"), 5)).first()[0] == ["a@x.example", "b@x.example"]


def test_windows_are_the_same_joined(spark):
    reg = spark.createDataFrame([("P1", "home visit nurse"), ("P2", "food boxes card")], "doc_id string, text string")
    v, w = I.fit(reg)
    words = ("home-visit of a nurse " * 9 + "nothing here to see " * 20 + "food card boxes " * 5 + "end " * 70).split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nurse"), (3, ""), (4, "none of it"), (5, " ".join(words[:61]))], "id long, t string")
    absent = reg.select(F.col("doc_id").alias("program_id"))
    got, joined = (sorted(map(tuple, I.scan_windows(docs, absent, v, w, "id", F.col("t"), 0.2, broadcast_weights=n).collect())) for n in (10**6, 0))
    assert got == joined and {r[0] for r in got} == {1, 2, 5}


def test_name_matches_against_all_pairs(spark):
    gold = spark.createDataFrame([("c", "Home Visits"), ("c", "Food"), ("d", "Food"), ("c", "")], "county string, g string")
    found = spark.createDataFrame([("c", "home visits program"), ("c", "Food"), ("c", "Food"), ("e", "Food"), ("c", None)], "county string, f string")
    got = {(r["gold_name"], r["found_name"], round(r["f1"], 3)) for r in name_matches(gold, found, "county", "g", "f").collect()}
    assert got == {("Home Visits", "home visits program", 0.8), ("Food", "Food", 1.0)}
