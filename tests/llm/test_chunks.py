"""Chunks cut without regard to lines, against a plain count; the same rows with and without a broadcast."""

from collections import defaultdict

import pytest

from millrace.llm import repeated

NOTICE = "This county keeps no copies of the papers that you send, and a letter with the date of your visit will follow within ten working days of the talk. "
OWN = ["Crib kits and diapers wait at the door for you", "A nurse reads the chart with each family in spring", "Rides home are free after dark, ask for the blue card", "Our doula meets partners on the first floor in May", "Soup and bread are served while the little ones nap", "The van stops near the mill when the bells have rung", "Songs in two languages open the morning circle here", "Write down what the baby ate and when it slept well"]


def rows():
    out = [(i, "Kern County" if i % 2 else " kern", f"{OWN[i]}. {NOTICE if i % 3 else NOTICE.replace(' and ', chr(10) + 'and ')}{OWN[i][::-1]} é界") for i in range(8)]
    return [*out, (8, None, NOTICE), (9, "other", NOTICE), (10, "kern", None), (11, "kern", ""), out[0]]


def brute(data):
    """id -> text, by a dictionary over all chunks."""
    docs, ids = defaultdict(set), defaultdict(set)
    one = {i: (s, t) for i, s, t in data}
    key = lambda s: s and s.strip().lower().removesuffix("county").strip()
    for i, (s, t) in one.items():
        if s is not None:
            ids[key(s)].add(i)
            _, folded, ends = repeated.chunk_ends(t or "")
            for a, b in zip([0, *ends], ends):
                docs[key(s), folded[a:b]].add(i)
    out = {}
    for i, (s, t) in one.items():
        raw, folded, ends = repeated.chunk_ends(t or "")
        spans = list(zip([0, *ends], ends))
        out[i] = t if t is None else b"".join(raw[a:b] for a, b in spans if s is None or len(docs[key(s), folded[a:b]]) < max(5, 0.15 * len(ids[key(s)]))).decode()
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_cut_chunks(spark, most):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, county string, text string, chunk int")
    got = {r["id"]: (r["text"], r["cut_chars"]) for r in repeated.cut_chunks(df, broadcast_chunks=most).collect()}
    assert {i: t for i, (t, _) in got.items()} == brute(rows())
    assert got[8] == (NOTICE, 0) and got[9] == (NOTICE, 0) and got[10] == (None, 0) and got[11] == ("", 0)
    assert all(n > 20 and "é界" in t for i, (t, n) in got.items() if i < 8)
    assert repeated.cut_chunks(df.where("false"), broadcast_chunks=most).count() == 0


def test_ends_lie_between_characters():
    for text in ("界" * 500, "é" * 300 + "abc " * 200, "", "x", NOTICE * 20):
        raw, _, ends = repeated.chunk_ends(text)
        assert "".join(raw[a:b].decode() for a, b in zip([0, *ends], ends)) == text


@pytest.mark.parametrize("most", [10**6, 0])
def test_clean_texts(spark, most):
    lines = [(i, "Kern" if i % 2 else "kern county", f"Share  this page {i}\nown line {'abcdefgh'[i]}\n\n{NOTICE}") for i in range(8)]
    data = [*lines, (8, None, "Share this page 1"), (9, "kern", None), (10, "kern", ""), (11, "other", "Share this page 1"), lines[0]]
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, county string, text string, line int")
    got = sorted((r["id"], r["text"] or "") for r in repeated.clean_texts(df, broadcast_lines=most).collect())
    wanted = sorted((i, "Share this page 1" if i in (8, 11) else t and f"own line {'abcdefgh'[i]}\n" or "") for i, _, t in data)
    assert got == wanted
    assert repeated.clean_texts(df.where("false"), broadcast_lines=most).count() == 0
