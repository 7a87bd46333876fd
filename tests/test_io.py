import json

from pyspark.sql import functions as F

from millrace.operators.dialog import fold_turns
from millrace.operators.pages import crawl, parse_html, parse_pages
from millrace.operators.retrieve import fixed_chunks, nearest
from millrace.runtime import unique_by
from millrace.sources import files, sinks
from millrace.streaming.streams import first_by_fingerprint, run_once, windowed_counts

HTML = """<html><head><title>T</title></head><body><nav>Menu <a href="/staff">Staff</a></nav><h1>WIC</h1><main><p>Call (555) 123-4567 or write to a@b.example.
<a href="docs/a.pdf#p1">Flyer</a> <a href="https://other.example/x">Other</a><a href="mailto:x">m</a></main><footer>Foot</footer><script>var x</script></body></html>"""


def test_parse_html():
    p = parse_html(HTML, "https://a.example/x/")
    assert p["h1"] == "WIC" and "Menu" not in p["text"] and "Foot" not in p["text"] and "var x" not in p["text"]
    assert [x["url"] for x in p["links"]] == ["https://a.example/staff", "https://a.example/x/docs/a.pdf", "https://other.example/x"]


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, "https://a.example/x/", HTML), (2, "https://a.example", None), (3, None, "")], "id long, u string, h string")
    got = {r["id"]: r for r in parse_pages(df, "id", "u", "h").collect()}
    assert got[1]["name"] == "WIC" and got[1]["phones"] == ["(555) 123-4567"] and got[1]["pdf_links"] == ["https://a.example/x/docs/a.pdf"]
    assert got[2]["text"] is None and got[3]["text"] == "" and got[3]["name"] == "Untitled"


def test_crawl(spark):
    seeds = spark.createDataFrame([("c", "s")], "county string, url string")
    links = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("a", "d", 1), ("b", "e", 1), ("d", "z", 1), ("a", "s", 2)], "src string, dst string, pos int")
    pages = spark.createDataFrame([("s", True, False), ("a", True, True), ("b", False, True), ("d", True, True), ("e", True, True), ("z", True, True)], "url string, expands boolean, saved boolean")
    got = [(r["url"], r["depth"]) for r in crawl(seeds, links, pages).orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 1), ("d", 2)]
    assert [r["url"] for r in crawl(seeds, links, pages, most_pages=1).collect()] == ["a"]


def test_raw_pages_with_a_broken_file(spark, tmp_path):
    for county, name, content in (("fresno", "a", {"county": "Fresno", "page_url": "u", "text": "t", "contacts": {"phones": ["1"], "emails": []}}), ("fresno", "b", {"page_url": "v", "text": ""})):
        (tmp_path / county).mkdir(exist_ok=True)
        (tmp_path / county / f"{name}.json").write_text(json.dumps(content, indent=1))
    (tmp_path / "kern").mkdir()
    (tmp_path / "kern" / "x.json").write_text("{broken")
    pages, rejects = files.read_raw_pages(spark, str(tmp_path))
    assert sorted((r["county"], r["page_url"]) for r in pages.collect()) == [("Fresno", "u"), ("fresno", "v")]
    assert rejects.count() == 1
    assert files.read_raw_pages(spark, str(tmp_path), "kern")[0].count() == 0


def test_programs_by_version(spark, tmp_path):
    for v in (2, 10):
        d = tmp_path / f"v{v}"
        d.mkdir()
        head = ",".join(files.CSV_COLUMNS)
        row = lambda name: ",".join(['"' + (name if c == "Program_Name" else 'a ""b""\nc') + '"' for c in files.CSV_COLUMNS])
        (d / "California_X.csv").write_text(f"{head}\n{row('P')}\n{row(' ')}\n")
        (d / "California_combined.csv").write_text(f"{head}\n{row('Q')}\n")
    df = files.read_programs(spark, str(tmp_path))
    assert sorted((r["version"], r["Program_Name"], r["Notes"]) for r in df.collect()) == [(2, "P", 'a "b"\nc'), (10, "P", 'a "b"\nc')]
    named = spark.createDataFrame([("v2",), ("v10",), ("x",), (None,)], "v string")
    assert [r[0] for r in files.latest_version(named, "v").collect()] == ["v10"]


def test_gold_and_discovery(spark, tmp_path):
    gold = {"county_name": "X", "county_url": "u", "programs": [{"program_name": "P", "program_url": "p", "category": "c", "pdf_links": []}]}
    (tmp_path / "gold.jsonl").write_text(json.dumps(gold) + "\n\n" + json.dumps(gold | {"county_name": "Y", "programs": []}) + "\n")
    assert [(r["county_name"], r["program_name"]) for r in files.read_gold(spark, str(tmp_path / "gold.jsonl")).collect()] == [("X", "P")]
    (tmp_path / "d.json").write_text(json.dumps({"generated_at": "t", "results": [{"county_name": "X", "programs": [{"name": "n", "score": 1.5}]}]}, indent=1))
    assert files.read_discovery(spark, str(tmp_path / "d.json")).first()["programs"][0]["score"] == 1.5


def test_published_rows_have_a_placeholder(spark):
    counties = spark.createDataFrame([("1", "A", None, None, "", "p"), ("2", "B", "u", "d", "e", None)], "county_code string, county_name string, county_website_url string, health_department_name string, health_department_contact_email string, health_department_contact_phone string")
    names = [f.lower() for f in ("program_name", "program_category", "program_description", "target_population", "eligibility_requirements", "application_process", "required_documentation", "financial_assistance_available", "program_website_url", "notes")]
    programs = spark.createDataFrame([("2", "P", *[None] * 9)], "county_code string, " + ", ".join(f"{n} string" for n in names))
    got = sinks.publish_rows(counties, programs, "2026-01-01")
    assert got.columns == files.CSV_COLUMNS
    assert sorted((r["County_Name"], r["Program_Name"], r["Program_Category"], r["Financial_Assistance_Available"]) for r in got.collect()) == [("A", "Not found", "Other", "Unknown"), ("B", "P", "Other", "Unknown")]


def test_pages_written_once_a_key(spark, tmp_path):
    df = spark.createDataFrame([("A B", "u", "N", 1), ("A B", "u", "N", 2), ("C", "w", None, 1)], "county string, page_url string, program_name_guess string, scraped_at int")
    sinks.write_pages(df, str(tmp_path / "raw"))
    back = spark.read.json(str(tmp_path / "raw"))
    assert sorted((r["county_slug"], r["scraped_at"]) for r in back.collect()) == [("a-b", 2), ("c", 1)]
    sinks.rewrite_partitions(spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int"), str(tmp_path / "t"), "k")
    sinks.rewrite_partitions(spark.createDataFrame([("x", 2)], "k string, v int"), str(tmp_path / "t"), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect())) == [("x", 2), ("y", 1)]
    sinks.write_versioned(spark.createDataFrame([("A", 1)], "County_Name string, v int"), str(tmp_path / "out"), 3)
    assert (tmp_path / "out" / "v3" / "combined").is_dir()


def test_conversation(spark):
    df = spark.createDataFrame([(1, 1, "hi"), (1, 2, "I live in Kern"), (1, 3, "no"), (1, 4, "fresno!"), (1, 5, "Yes"), (1, 6, "thanks"), (2, 1, None)], "conversation int, turn int, text string")
    got = {r["conversation"]: (r["step"], r["county"], r["n_turns"]) for r in fold_turns(df, ["Fresno", "Kern"]).collect()}
    assert got == {1: ("done", "Fresno", 6), 2: ("ask", None, 1)}


def test_neighbours_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<float>")
    few = df.where("vec_id % 10 = 0")
    a, b = nearest(few, df, 3), nearest(few, df, 3, block_queries=2)
    key = lambda x: sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in x.collect())
    assert key(a) == key(b) and a.count() == 12
    assert nearest(df.where("false"), df, 3).count() == 0


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    got = fixed_chunks(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, t string"), "id", F.col("t")).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in got] == [text[:800], text[700:1500], text[1400:2000]]


def test_streams(spark, tmp_path):
    rows = [(1, "a b", "2026-01-01 00:00:00"), (2, "A  B", "2026-01-01 01:00:00"), (3, "c", "2026-01-01 02:00:00")]
    spark.createDataFrame(rows, "id int, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string, at timestamp").parquet(str(tmp_path / "in"))
    assert run_once(first_by_fingerprint(stream, "text", "at"), "first").count() == 2
    counts = run_once(windowed_counts(stream, "at", "text"), "counts")
    assert counts.where("n <> 1").count() == 0


def test_unique_by(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id int, v string")
    assert sorted(str(r["id"]) for r in unique_by(df, "id").collect()) == ["1", "2", "None"]
    once = df.distinct()
    assert unique_by(once, "id").count() == 3


def test_boundary(spark):
    from millrace.operators.boundary import complete, parse_reply

    df = spark.createDataFrame([(1, "Food help\nYou qualify if pregnant. Call 555-0100."), (2, None), (3, "x")], "i long, p string")
    good, bad = parse_reply(complete(df, "i", "p"))
    got = {r["id"]: r for r in good.collect()}
    assert got[1]["program_name"] == "Food help" and got[1]["eligibility"] == "You qualify if pregnant." and [r["id"] for r in bad.collect()] == [2]

    def fails(p):
        raise OSError(p)

    assert parse_reply(complete(df, "i", "p", fails))[0].count() == 0


def test_index_finds_most_of_the_nearest(spark):
    import numpy as np

    from millrace.operators.retrieve import fit_cells, fit_probes, index_vectors, nearest_indexed

    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=16) + 3 * np.eye(16)[i % 16]).tolist()) for i in range(1500)] + [(2000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0")
    centres = fit_cells(v)
    index = index_vectors(v, centres)
    assert index.count() == 1500 and len(centres) == 38
    exact, found = ({(x["query_id"], x["neighbour_id"]) for x in df.collect()} for df in (nearest(q, v, 10), nearest_indexed(q, index, centres, 10)))
    blocks = {(x["query_id"], x["neighbour_id"]) for x in nearest_indexed(q, index, centres, 10, block_queries=10).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and blocks == found
    assert 1 <= fit_probes(v, centres) <= len(centres) and fit_probes(v, centres, recall=1.0) >= fit_probes(v, centres)
    whole = {(x["query_id"], x["neighbour_id"]) for x in nearest_indexed(q, index, centres, 10, probes=len(centres)).collect()}
    assert whole == exact and nearest_indexed(q, index.where("false"), centres).count() == 0
