"""Shapes of addresses, and names on both ways of bringing the words of names to the documents."""

import pytest

from millrace.llm import pii


@pytest.mark.parametrize("address", ["215 5th Avenue", "1200 Martin Luther King Jr Blvd", "1200 Martin Luther King Jr. Blvd", "88 O'Farrell St", "9 St. John's Rd", "7 Winston-Salem Dr", "10 North 42nd Street", "31 Avenue of the Giants Pkwy, Apt 5"])
def test_addresses(address):
    text = f"She lives at {address}, near the park."
    assert [(k, text[a:b]) for k, a, b in pii.find_pii(text, pii.NameModel({}))] == [("address", address)]


@pytest.mark.parametrize("text", ["Parents who finish 9 lessons on building a support circle receive a book.", "It holds 72 people. The Ravenell Street office keeps more.", "Call within 78 days to ask for help. Dr. Pascua signs."])
def test_no_addresses(text):
    assert pii.find_pii(text, pii.NameModel({})) == []


def test_names_with_apostrophes_on_both_ways(spark):
    rows = [(k, f"Thanks, {g} O'Brien, for the visit.") for k, g in enumerate(("Tindra", "Paloma", "Tindra", "Paloma"))]
    docs = spark.createDataFrame([*rows, (9, "Zarix O’Brien wrote."), (10, None)], "doc_id long, text string")
    known = spark.createDataFrame([("Tindra", "given"), ("Paloma", "given"), ("O'Brien", "family"), ("O’Brien", "family")], "name_text string, name_kind string")
    few, many = ({tuple(r) for r in pii.personal_information(docs, known, broadcast_words=most).collect()} for most in (10**6, 0))
    assert few == many and {r[3] for r in few} >= {"Tindra O'Brien", "Paloma O'Brien"}


def test_words_of_documents_are_those_of_the_model(spark):
    """The potentials stand under the word with its apostrophe only."""
    docs = spark.createDataFrame([(1, "We met Wenlis O'Brien.")], "doc_id long, text string")
    known = spark.createDataFrame([("Wenlis", "given"), ("O'Brien", "family")], "name_text string, name_kind string")
    assert [r["found"] for r in pii.personal_information(docs, known, broadcast_words=0).collect()] == ["Wenlis O'Brien"]


def test_long_local_parts_and_lines():
    mail = "a" * 300 + "@" + "b" * 300 + ".example"
    assert [(k, s, e) for k, s, e in pii.find_pii("word " * 2000 + mail + " and more", pii.NameModel({}))] == [("email", 10_000, 10_000 + len(mail))]
    text = "Write to jo [at] clinic [dot] example, or to ann at clinic dot example today.\nMeet at noon, dot by dot."
    assert [text[s:e] for _, s, e in pii.find_pii(text, pii.NameModel({}))] == ["jo [at] clinic [dot] example", "ann at clinic dot example"]


def test_windows_are_wider_than_any_match():
    phone, number = "+123  (555)  555  5555, extension 123456", "ABCD-1234-1234-1"
    for gap in (0, 1, 30, 70, 500):
        text = f"{'1 2 ' * gap}call {phone} or {number} {'x1 ' * gap}"
        got = {text[s:e] for k, s, e in pii.find_pii(text, pii.NameModel({})) if k != "address"}
        assert {phone, number} <= got


SURE = {"tindra": (4.0, -6.0), "okafor": (-6.0, 4.0), "maris": (0.2, -6.0), "quell": (-6.0, -3.5)}
TEXT = "Tindra Quell opened the meeting. Later Quell, Tindra spoke again, and Maris Quell signed."


def test_skip_edges_make_occurrences_agree():
    """Quell is doubtful as a family name; beside a sure given name it is one, and its other places follow."""
    names = lambda skip: [TEXT[a:b] for a, b in pii.NameModel(SURE, skip).names(TEXT)]
    assert names(3.0) == ["Tindra Quell", "Quell, Tindra", "Maris Quell"] and names(0.0) != names(3.0)


def test_skip_edges_join_similar_words():
    found = pii._tokens("Ana Núñez came. Ana Nunez left. O'Brien met OBrien, Okafors and Okafor.")
    edges = [(found[i][2], found[j][2]) for i, j in pii._skip_edges(found, {i: {} for i in range(len(found))})]
    assert ("ana", "ana") in edges and ("núñez", "nunez") in edges and ("o'brien", "obrien") in edges


def test_long_stretches_of_capitalised_words():
    """A chain is the whole stretch: a name far from the first known word is found."""
    text = "Tindra " + "Hall " * 12 + "Tindra Okafor"
    assert [text[a:b] for a, b in pii.NameModel(SURE).names(text)][-1] == "Tindra Okafor"


def test_rare_words_count(spark):
    """A word met once, beside a known name, and nowhere else is a name."""
    docs = spark.createDataFrame([(1, "We met Tindra Wexcombe."), (2, "Visit Tindra Hall, then " + "the Hall, " * 20)], "doc_id long, text string")
    known = spark.createDataFrame([("Tindra", "given")], "name_text string, name_kind string")
    assert [r["found"] for r in pii.personal_information(docs, known).collect()] == ["Tindra Wexcombe"]


def test_redaction_leaves_the_rest(spark):
    docs = spark.createDataFrame([(1, "Call Tindra Okafor at 555-555-0100.\n\tBye"), (2, ""), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([("Tindra", "given"), ("Okafor", "family")], "name_text string, name_kind string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs, known).collect()} == {1: "Call <NAME> at <PHONE>.\n\tBye", 2: "", 3: None}
