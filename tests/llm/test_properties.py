"""Properties over random inputs, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, canon, leaks, neardup, repeated, split
from millrace.llm.common import words

TEXT = st.text(st.sampled_from("ab .,\n\t界。 é-?"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 60), st.data())
def test_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    p = split.plan_pieces(text, limit, overlap)
    assert bool(p) == bool(text)
    if p:
        assert p[0][0] == 0 and p[-1][1] == len(text)
        assert all(0 < e - s <= limit for s, e, _ in p)
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(p, p[1:]))


CODER = None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    global CODER
    if CODER is None:
        with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
            CODER = bpe.BytePairs(f.read())
    text = text.encode("utf-8", "ignore").decode()
    assert CODER.decode(CODER.encode(text)) == text


def edits(a, b, free):
    """Edit distance by the table; free: b may have anything before and behind."""
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return min(row) if free else row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_distances(a, b):
    assert canon.distance(a, b) == edits(a, b, False) == canon.distance(b, a)
    assert leaks.myers(list(map(ord, a)), list(map(ord, b))) == edits(a, b, True)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB9 _-.éΣ•中½\n"), max_size=60))
def test_words_by_bytes(text):
    import xxhash

    assert neardup._word_hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words(text)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300))
def test_bitmaps_never_promise_too_little(a, b):
    """Bitmaps differ in no more bits than the sets have different tokens, at any size."""
    x, y = (np.array(sorted(s), np.uint64) for s in (a | set(list(b)[:200]), b))
    levels = np.array([neardup._level(len(x)), neardup._level(len(y))])
    table, offset = neardup._bitmap_table([neardup._bitmap(x).tobytes(), neardup._bitmap(y).tobytes()], levels)
    bits = neardup._differ(table, offset, levels, np.array([0]), np.array([1]))[0]
    assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1\té "), max_size=90), max_size=6))
def test_lines_keep_their_chunks(lines):
    text = "\n".join(lines)
    _, no, counts, chunks = repeated.chunk_texts([text], np.zeros(1, np.uint64))
    full = [i for i, x in enumerate(lines, 1) if repeated.normal_text(x).strip(" ")]
    assert no.tolist() == full and counts.sum() == len(chunks)
    at = 0
    for n, c in zip(no.tolist(), counts.tolist()):
        assert repeated.chunk_texts([lines[n - 1]], np.zeros(1, np.uint64))[3].tolist() == chunks[at : at + c].tolist()
        at += c
