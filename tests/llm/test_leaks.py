"""Passages with an edit, planted and compared with a plain edit distance over all windows."""

import random

from millrace.llm import leaks


def least(window, text):
    """The least edit distance of the window to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(window, 1):
        nxt = [i]
        for j, y in enumerate(text, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return min(row)


def test_planted_edits(spark):
    r = random.Random(7)
    word = lambda n: f"w{r.randrange(n)}"
    items = [(i, [word(400) for _ in range(r.randrange(8, 30))]) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word(400) for _ in range(r.randrange(0, 60))]
        if d % 2:
            own = items[d % 12][1]
            a = r.randrange(0, max(1, len(own) - 10))
            part = own[a : a + r.randrange(10, 14)]
            for _ in range(d % 4):  # none to three edits
                k = r.randrange(len(part))
                part[k : k + r.randrange(0, 2)] = [word(400)] * r.randrange(0, 2)
            at = r.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, text))
    wanted = set()
    for d, text in docs:
        for i, own in items:
            near = [x for a in range(len(own) - 9) if (x := least(own[a : a + 10], text)) <= 1]
            if near:
                wanted.add((d, i, min(near)))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["distance"]) for x in leaks.leaks(df, table).collect()}
    assert got == wanted and {d for *_, d in wanted} == {0, 1} and len(wanted) > 15
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in leaks.leaks(df, table, block_chars=500).collect()} == wanted
