import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gates as G
from millrace.operators import matching as M
from millrace.operators import metrics as E
from millrace.operators import ordering as O
from millrace.operators import tfidf as I


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_token_f1(spark):
    f1 = lambda a, b: one(spark, T.token_f1(F.lit(a), F.lit(b)))
    assert f1("", "") == 1.0 and f1("", "x") == 0.0 and f1("a b", "c d") == 0.0
    assert f1("The WIC program!", "wic program, the") == 1.0
    assert math.isclose(f1("a b c", "a b"), 0.8) and f1("a b c", "a b") == f1("a b", "a b c")


def test_fingerprint_ignores_case_space_and_what_is_behind(spark):
    a, b = "Hello  World\n" + "x" * 2000 + "tail", "hello world " + "x" * 2000
    fp = lambda t: one(spark, T.fingerprint(F.lit(t)))
    assert fp("Hello  World") == fp("hello world") and fp(a) != fp("other")
    assert one(spark, T.fingerprint(F.lit("A" * 2000 + "1"))) == one(spark, T.fingerprint(F.lit("a" * 2000 + "2"))) and fp(b)


def test_urls(spark):
    assert one(spark, T.url_key(F.lit("HTTPS://A.example/Path/?q=1#f"))) == "https://a.example/path"
    assert one(spark, T.path_parts(F.lit("https://a.example/home-visit/x_y.html"))) == ["home", "visit", "x", "y", "html"]
    assert one(spark, T.same_domain(F.lit("https://a.example"), F.lit("https://www.a.example/x")))
    assert not one(spark, T.same_domain(F.lit("https://a.example"), F.lit("https://ba.example/x")))


@pytest.mark.parametrize("text, phones, emails", [("Call (555) 123-4567", ["(555) 123-4567"], []), ("555.123.4567 or a@b.example, c@d.example", ["555.123.4567"], ["a@b.example", "c@d.example"]), ("no contacts", [], [])])
def test_contacts(spark, text, phones, emails):
    assert one(spark, T.phones(F.lit(text))) == phones and one(spark, T.emails(F.lit(text))) == emails


def test_page_gate_at_its_limit(spark):
    df = spark.createDataFrame([(n, "wic " + "x" * (n - 4)) for n in (199, 200, 201)] + [(0, None), (1, "y" * 300)], "id int, text string")
    got = {r["id"]: r["reason"] for r in G.page_gate(df, ["wic"]).collect()}
    assert got == {199: "page too short", 200: "program page", 201: "program page", 0: "page too short", 1: "no registry signal"}


def test_url_gate_order(spark):
    rows = [("ftp://a", "Some long link text"), ("https://a.example/x", "Click here"), ("https://a.example/x", "ab"), ("https://a.example/news/wic", "Something"), ("https://a.example/wic", "Something"), ("https://a.example/home-visit", "Something"), ("https://a.example/x", "four words of text"), (None, "Something")]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "i int, u string, t string")
    got = [r[0] for r in df.orderBy("i").select(G.url_gate(F.col("u"), F.col("t"), ["home visit"])["reason"]).collect()]
    assert got == ["invalid url", "generic link text", "link text too short", "bad url segment", "good url segment", "alias in url path", "substantive link text", "invalid url"]


def registry(spark):
    return spark.createDataFrame([("B", "Healthy Start Program", ["healthy start", "pat"]), ("A", "Doula Care Network", ["doula care", "pat"])], "program_id string, canonical_name string, county_aliases array<string>")


def test_registry_passes(spark):
    reg = registry(spark)
    dim = M.alias_dimension(reg)
    assert {r["alias"]: r["program_id"] for r in dim.collect()} == {"healthy start": "B", "doula care": "A", "pat": "B"}
    df = spark.createDataFrame([(1, "a patient"), (2, "care by a doula"), (3, "network of healthy program"), (4, "nothing"), (5, None)], "id int, t string")
    got = {r["id"]: (r["program_id"], r["confidence"]) for r in M.match_registry(df, dim, reg, "id", F.col("t")).collect()}
    assert got == {1: ("B", 1.0), 2: ("A", 0.8), 3: ("B", 0.5), 4: (None, 0.0), 5: (None, 0.0)}


def test_classify_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "infant food"), (2, "food bank food card"), (3, "none")], "id int, t string")
    got = {r["id"]: (r["type"], r["score"]) for r in M.classify(df, [("X", "infant", 1), ("Y", "food", 1), ("Y", "card", 1)], "id", F.lower("t")).collect()}
    assert got == {1: ("X", 1.0), 2: ("Y", 2.0), 3: (None, 0.0)}


def test_dictionary_is_bounded(spark):
    with pytest.raises(ValueError):
        M.dictionary(spark.range(11), "id", most=10)


def test_first_named_is_the_same_joined(spark):
    df = spark.createDataFrame([(1, "in Alpha and Beta"), (2, "BETA only"), (3, "none"), (4, None)], "id int, t string")
    names = spark.createDataFrame([("Beta",), ("Alpha",)], "name string")
    a = sorted(map(tuple, M.first_named(df, names, "id", F.col("t")).collect()))
    assert a == [(1, "Alpha"), (2, "Beta")] == sorted(map(tuple, M.first_named(df, names, "id", F.col("t"), block_terms=1).collect()))


@pytest.mark.parametrize("n, starts", [(0, [0]), (60, [0]), (61, [0]), (90, [0]), (91, [0, 30]), (100, [0, 30])])
def test_windows(spark, n, starts):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, t string")
    got = I.word_windows(df, "id", F.col("t")).orderBy("start").collect()
    assert [r["start"] for r in got] == starts and all(len(r["window"].split()) <= 60 for r in got)


def test_best_match_keeps_the_score_below_the_threshold(spark):
    v, w = I.fit(spark.createDataFrame([("A", "infant reading club"), ("B", "farm voucher")], "doc_id string, text string"))
    q = I.vectors(I.term_counts(spark.createDataFrame([(1, "reading infant club"), (2, "zzz"), (3, "")], "id int, t string"), "id", F.col("t")), w)
    assert [tuple(r) for r in I.best_match(q, v).collect()] == [(1, "A", 1.0)]
    assert I.best_match(q, v, 1.1).first()["program_id"] is None


def test_metrics_of_empty_sets(spark):
    gold = spark.createDataFrame([("c", "a"), ("c", "b")], "g string, k string")
    none = gold.where("false")
    assert E.precision_recall(gold, none, "g", "k").first().asDict() == {"g": "c", "tp": 0, "fp": 0, "fn": 2, "precision": 0.0, "recall": 0.0}
    assert E.precision_recall(none, none, "g", "k").count() == 0
    ranked = spark.createDataFrame([("c", "a", 1), ("c", "x", 2), ("c", "b", 3)], "g string, k string, r int")
    got = E.recall_at(gold, ranked, "g", "k", "r", [1, 3]).first()
    assert (got["recall_at_1"], got["recall_at_3"]) == (0.5, 1.0)


def test_ndcg(spark):
    df = spark.createDataFrame([("c", 1, 0), ("c", 2, 1), ("d", 1, 0)], "g string, r int, rel int")
    assert {x["g"]: x["ndcg"] for x in E.ndcg(df, "g", "r", "rel", 10).collect()} == {"c": round(1 / math.log2(3), 6), "d": 0.0}


def test_orders(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(r["v"] for r in O.first_wins(df, [F.col("k")], [F.col("o")]).collect()) == ["y", "z"]
    assert sorted(r["v"] for r in O.last_wins(df, [F.col("k")], [F.col("o")]).collect()) == ["x", "z"]
    assert [(r["k"], r["v"]) for r in O.argmax(df, ["k"], F.lit(1), F.col("o"), ["v"]).orderBy("k").collect()] == [("a", "y"), ("b", "z")]


def test_first_wins_twice_changes_nothing(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    once = O.first_wins(df, [F.col("k")], [F.col("o")])
    assert sorted(once.collect()) == sorted(O.first_wins(once, [F.col("k")], [F.col("o")]).collect())
