"""Problem 1: oversized texts into pieces of at most `limit` characters that share `overlap` characters."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches
from millrace.runtime import spread

#: Characters behind which a text may be cut without breaking a word (fixed values of TESTDATA.md).
_CLASS = " \t\n\u00a0\u3000\u3002"
#: Boundaries, the strongest first; a cut lies at the end of the match, behind one of these characters.
_KINDS = {
    "paragraph": re.compile("\n[ \t\r\u00a0]*\n(?:[ \t\r\n\u00a0]*[ \t\n\u00a0])?"),
    "line": re.compile("\n"),
    "sentence": re.compile("[.!?…][\"'”’)\\]]*[ \t\u00a0\u3000]|\u3002"),
    "clause": re.compile("[,;:][ \t\u00a0\u3000]"),
    "space": re.compile("[ \t\u00a0\u3000]"),
}


def _near(text: str, target: int, low: int, high: int) -> tuple[int, str] | None:
    """The place in low..high nearest to target at a boundary of the strongest kind there, and the kind."""
    for name, pattern in _KINDS.items():
        ends = [m.end() for m in pattern.finditer(text, max(0, low - 1), high)]
        if ends := [e for e in ends if low <= e <= high]:
            return min(ends, key=lambda e: (abs(e - target), e)), name
    return None


def plan_pieces(text: str, limit: int = 800, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of each piece, from 0.

    Balanced targets: the least number of pieces is computed, equal-length targets are placed, each is snapped to the
    strongest boundary near it (the nearest of these), or, if there is none near, to the nearest that keeps all limits.
    If a limit can't be kept with so many pieces, more are tried. Only a run without boundary that fills a target's
    whole reach is cut inside, at the target: "forced" if the run is longer than the limit, else "overlap" (a run of
    limit - overlap to limit characters, which would fit a piece but not one that also holds the overlap). Elsewhere
    in the text pieces stay balanced. A piece starts exactly `overlap` characters before the end of the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    size = len(text)
    if size <= limit:
        return [(0, size, "end")] if size else []
    step = limit - overlap
    runs = [m.span() for m in re.finditer(f"[^{_CLASS}]{{{step},}}", text)]
    n = -(-(size - overlap) // step)
    while (ends := _snap(text, size, step, overlap, n, runs, limit)) is None:
        n += max(1, n // 16)
    out, start = [], 0
    for e, kind in ends:
        out.append((start, e, kind))
        start = e - overlap
    return [*out, (start, size, "end")]


def _snap(text: str, size: int, step: int, overlap: int, n: int, runs: list[tuple[int, int]], limit: int) -> list[tuple[int, str]] | None:
    """The ends of all pieces but the last, if n pieces are enough."""
    ends, last, near = [], overlap, step // 4
    for i in range(1, n):
        target = overlap + (size - overlap) * i // n
        low, high = max(last + 1, size - (n - i) * step), min(last + step, size - 1)
        if high >= size - overlap and last >= size - step:
            break  # what is left fits the last piece
        target = min(max(target, low), high)
        found = _near(text, target, max(low, target - near), min(high, target + near)) or _near(text, target, low, high)
        if found is None:
            run = next((r for r in runs[bisect_right(runs, (target, size)) - 1 :][:1] if r[0] < target <= r[1]), None)
            if run is None:
                return None
            found = target, "forced" if run[1] - run[0] > limit else "overlap"
        ends.append(found)
        last = found[0]
    return ends if size - last <= step else None


def cut_of(pieces: list[tuple[int, int, str]]) -> str:
    """"whole" for one piece, "forced" if a run longer than the limit had to be cut, else "natural"."""
    return "whole" if len(pieces) < 2 else "forced" if any(k == "forced" for _, _, k in pieces) else "natural"


_SCHEMA = "id long, n_chars long, cut string, pieces array<struct<piece_no:int,start_pos:long,end_pos:long,boundary:string>>"


def split_oversized(df: DataFrame, id_col: str = "page_id", text_col: str = "text", limit: int = 800, overlap: int = 100) -> DataFrame:
    """A row for each row of df: id, n_chars, cut, pieces (1-based positions, both inclusive).

    cut comes from the pieces: "whole" for one piece or none, "forced" if a piece ends inside a run of more than `limit`
    characters without a boundary (as any such run makes it), else "natural". A null text has null n_chars, cut and
    pieces, an empty one no pieces and cut "whole". Repeated rows give repeated results; other columns of df don't
    matter."""

    def of(b: pa.RecordBatch):
        ids, sizes, cuts, pieces = b.column(0), [], [], []
        for t in b.column(1).to_pylist():
            if t is None:
                sizes.append(None), cuts.append(None), pieces.append(None)
                continue
            sizes.append(len(t))
            plan = plan_pieces(t, limit, overlap)
            cuts.append(cut_of(plan))
            pieces.append([{"piece_no": i, "start_pos": s + 1, "end_pos": e, "boundary": k} for i, (s, e, k) in enumerate(plan, 1)])
        piece = pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("boundary", pa.string())])
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(cuts, pa.string()), pa.array(pieces, pa.list_(piece))], ["id", "n_chars", "cut", "pieces"])

    return map_batches(spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id"), of, _SCHEMA)


def piece_texts(df: DataFrame, id_col: str = "page_id", text_col: str = "text", limit: int = 800, overlap: int = 100) -> DataFrame:
    """id, piece_no, start_pos, end_pos, boundary, piece of each piece of each text; the texts are cut in the same task."""

    def of(b: pa.RecordBatch):
        rows = [(i, n, s + 1, e, k, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for n, (s, e, k) in enumerate(plan_pieces(t, limit, overlap), 1)]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "piece_no", "start_pos", "end_pos", "boundary", "piece"])

    return map_batches(spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id"), of, "id long, piece_no int, start_pos long, end_pos long, boundary string, piece string")
