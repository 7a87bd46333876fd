"""Pieces keep all limits whatever the runs without boundary, and `cut` that comes from them follows the definition."""

import random
import re

import pytest

from millrace.llm.split import _CLASS, cut_of, plan_pieces

PROSE = "word and more, with a sentence. " * 347
LONG_RUN = re.compile(f"[^{_CLASS}]{{801,}}")


@pytest.mark.parametrize("seed", range(20))
def test_random_texts(seed):
    r = random.Random(seed)
    for _ in range(20):
        t = ""
        for _ in range(r.randrange(1, 12)):
            k = r.random()
            if k < 0.3:
                t += "x" * r.choice([650, 699, 700, 701, 750, 799, 800, 801, 802, 1500, 2300])
            elif k < 0.5:
                t += r.choice(["\n\n", "\n", "。", "\r", "\n\n\r", "\r\r \r"]) * r.randrange(1, 4)
            else:
                t += " ".join("w" * r.randrange(1, 12) for _ in range(r.randrange(1, 300)))
            t += r.choice(["", " ", ". ", "\n"])
        if len(t) <= 800:
            continue
        p = plan_pieces(t)
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(e - s <= 800 for s, e, _ in p)
        assert all(b[0] == a[1] - 100 and b[1] > a[1] for a, b in zip(p, p[1:]))
        assert all(t[e - 1] in _CLASS for _, e, k in p[:-1] if k not in ("forced", "overlap"))
        assert cut_of(p) == ("forced" if LONG_RUN.search(t) else "natural")


def test_a_long_run_leaves_the_rest_balanced():
    sizes = [e - s for s, e, _ in plan_pieces(PROSE)]
    assert max(sizes) - min(sizes) <= 40
    with_run = plan_pieces(PROSE + "x" * 720 + " " + PROSE[:2000])
    assert max(e - s for s, e, _ in with_run[:12]) - min(e - s for s, e, _ in with_run[:12]) <= 40
    assert [k for _, _, k in with_run].count("overlap") == 1 and cut_of(with_run) == "natural"


def test_runs_longer_than_the_limit_are_forced():
    assert cut_of(plan_pieces(PROSE[:500] + "x" * 801)) == "forced" and cut_of(plan_pieces(PROSE[:500] + "x" * 800)) == "natural"
