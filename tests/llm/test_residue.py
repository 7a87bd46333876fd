"""Templates of messages: what is mined, what the verdicts on templates say, and which pages they reach."""

import pyarrow as pa
import pytest

from millrace.llm import mainbody, residue

SAMPLES = [
    "502 Bad Gateway", "400 Bad Request", "(503) Service", '"x y" - internal', "Connection refused", "Connection  reset", "Please enable cookies to continue", "Une erreur s'est produite", "This page is missing", "Internal problem",
    "Sign in with your county account to view this page", "Script is disabled", "  at java.lang.String(", 'File "x.py", in main', "file 12.php", "Activez cookies", "This page has them switched off", "You will have to log in again", "Verify that you are human",
]


@pytest.mark.parametrize("line", SAMPLES)
def test_samples_are_messages(line):
    assert residue.is_message(residue.mask(line))


def test_pages_of_one_message(spark):
    rows = [(k, x) for k, x in enumerate(SAMPLES) if residue.MESSAGE.search(residue.mask(x))] + [(99, "How a midwife can help\nPartners are welcome at each visit.\n502 Bad Gateway")]
    found = {r["id"] for r in residue.residue_pages(spark.createDataFrame(rows, "page_id long, text string")).collect()}
    assert found == {k for k, _ in rows} - {99}


FIREWALL = "Access to this page has been blocked by the firewall because the request looked like those of a program that reads many pages at once. If you think this is a mistake, write to the owner of the site and give the number 18-2231 of the incident together with the time."
SCRIPTS = "This website, which the county runs together with its partners in the region and with the help of many volunteers and several other offices of the state, which are too many to be named here, requires JavaScript"
PARAGRAPH = "A midwife visits you at home in the first weeks after birth. Partners are welcome when we discuss warning signs and feeding. Please enable JavaScript to use the translation tool. Bring the yellow card to each visit, and call the office if you have to change the day."


def test_long_notices(spark):
    assert min(len(residue.mask(x)) for x in (FIREWALL, SCRIPTS, PARAGRAPH)) >= residue.MESSAGE_CHARS
    short = "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h i j k l m n o p q r something went wrong."
    rows = [(1, FIREWALL), (2, "Home\nNews\n" + SCRIPTS), (3, PARAGRAPH), (4, short), (5, FIREWALL + "\nA midwife visits you at home."), (6, PARAGRAPH + "\nPage not found")]
    found = {r["id"] for r in residue.residue_pages(spark.createDataFrame(rows, "page_id long, text string")).collect()}
    assert found == {1, 2, 4}


def mined(messages):
    """message -> (template, verdict), as one task with all leaves finds it."""
    tree = residue.PrefixTree()
    of = {m: tree.add(m) for m in sorted(messages)}
    return {m: (" ".join(c[0]), residue.is_message(" ".join(c[0]))) for m, c in of.items()}


def test_telling_words_never_become_slots():
    both = ["the page is meant for all", "the page is gone for good", "the page is gone for today"]
    assert [mined(both)[m][1] for m in both] == [False, True, True]


WIDGETS = [f"the widget {w} could not be loaded" for w in ("carousel", "calendar", "gallery", "map")]


def test_the_tree_decides(spark):
    """A message that says nothing by itself is one by its template; without the others that show the slot it is none."""
    assert not any(residue.is_message(m) for m in WIDGETS)
    assert set(mined(WIDGETS).values()) == {("the widget <*> could not be loaded", True)}
    rows = [(k, x) for k, x in enumerate(WIDGETS)] + [(9, "A midwife visits you at home.\n" + WIDGETS[0])]
    pages = spark.createDataFrame(rows, "page_id long, text string")
    assert {r["id"] for r in residue.residue_pages(pages).collect()} == {0, 1, 2, 3}
    assert residue.residue_pages(pages.where("page_id in (0, 9)")).count() == 0
    t = {r["template"]: (r["bad"], r["messages"], r["pages"]) for r in residue.residue_templates(pages).collect()}
    assert t["the widget <*> could not be loaded"] == (True, 4, 5)


def test_leaves_stream_through_a_task():
    messages = sorted([*WIDGETS, "page not found", "we like maps", *(f"we like {w} and more of {w}" for w in "abc")], key=lambda m: (residue._name(repr(residue._KEYS.key(m.split(" ")))), m))
    leaf = [residue._name(repr(residue._KEYS.key(m.split(" ")))) for m in messages]
    batches = [pa.record_batch([pa.array(leaf[k : k + 2], pa.int64()), pa.array(messages[k : k + 2])], ["leaf", "message"]) for k in range(0, len(messages), 2)]
    out = pa.Table.from_batches(list(residue._mine(iter(batches)))).to_pylist()
    templates = {r["cluster"]: (r["template"], r["bad"]) for r in out if r["name"] is None}
    assert {r["name"]: templates[r["cluster"]] for r in out if r["name"]} == {residue._name(m): v for m, v in mined(messages).items()}


def test_frames_of_a_stack_trace_keep_their_name(spark):
    text = "Fatal exception java.lang.NullPointerException\n at org.portal.View.render(View.java:360)\nat org.portal.Main.go(Main.java:77)"
    assert residue.residue_pages(spark.createDataFrame([(1, text)], "page_id long, text string")).count() == 1


def test_long_furniture():
    notice = "We use cookies and small files to remember what you chose on your last visit. Cookies also tell us which pages are read most often, so that the county can improve them. You can refuse cookies in your browser."
    assert len(notice) > 188 and mainbody.kind_of(notice) == mainbody.kind_of(notice[:120]) == "cookie"
    paragraph = "A midwife visits you at home in the first weeks after birth and explains warning signs. Partners are welcome at each visit. The office keeps cookies and coffee ready for all who wait."
    assert mainbody.kind_of(paragraph) == "sentence" and mainbody.kind_of("Home visits 2024 " + "|".join(["00352"] * 40)) not in ("crumb", "bar")
