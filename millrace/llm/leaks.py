"""Problem 9: passages of evaluation texts inside documents.

Each window of an evaluation text that counts as a passage is split into error-budget-plus-one pieces; a document that
holds the window with no more edits than the budget holds one of the pieces exactly. Pieces found are verified by
Myers' bit-parallel edit distance over words."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, words
from millrace.runtime import spread

#: Evaluation texts are broadcast in blocks of at most so many characters; the documents are searched once a block.
BLOCK_CHARS = 32_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def myers(pattern: list[int], text: list[int]) -> int:
    """The least edit distance of pattern to any part of text (semi-global), bit-parallel over the pattern."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best = score
    return best


class Index:
    """Pieces of a block of items. A passage is `window` consecutive words; its budget + 1 pieces are disjoint, so
    at least one of them survives `budget` edits."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget = window, budget
        self.size = size = max(1, window // (budget + 1))
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            k = len(self.items)
            self.items.append((item, ids))
            # every start: a window's own pieces (at 0, size, ... from its start) are then all among them
            for p in range(len(ids) - size + 1) if len(ids) >= window else ():
                self.pieces[tuple(ids[p : p + size])].append((k, p))
        self.keys = np.sort(_hashes(np.array(list(self.pieces) or np.zeros((0, size)), np.int64).reshape(-1, size)))

    def matches(self, texts: list[str], allowed: int) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item, distance, passages, first word) for each text and item: the least distance of
        one of the item's passages to the text, if at most `allowed`, the number of passages at that distance, and
        where in the item the first of them starts."""
        size, get, ids, lengths = self.size, self.vocabulary.get, [], []
        for t in texts:
            found = words(t) if t else []
            ids.extend([get(w, -1) for w in found])
            ids.append(-1)
            lengths.append(len(found) + 1)
        all_ids = np.array(ids, np.int64)
        n = len(all_ids) - size + 1
        if n <= 0:
            return []
        inside = np.ones(n, bool)
        for j in range(size):
            inside &= all_ids[j : j + n] >= 0
        at = np.flatnonzero(inside)
        if len(at):
            h = _hashes(all_ids[at[:, None] + np.arange(size)])
            k = np.searchsorted(self.keys, h)
            at = at[self.keys[np.minimum(k, len(self.keys) - 1)] == h] if len(self.keys) else at[:0]
        ends = np.cumsum(lengths)
        owners = np.searchsorted(ends, at, "right")
        out: list[tuple[int, int, int, int, int]] = []
        for o in np.unique(owners).tolist():
            low, high = int(ends[o]) - lengths[o], int(ends[o]) - 1
            out += [(o, *m) for m in self._verify(ids[low:high], (at[owners == o] - low).tolist(), allowed)]
        return out

    def _verify(self, whole: list[int], at: list[int], allowed: int) -> list[tuple[int, int, int, int]]:
        size, window = self.size, self.window
        todo: dict[tuple[int, int], set[int]] = defaultdict(set)  # of an item, shifted against the text: places of pieces
        for p in at:
            for k, q in self.pieces.get(tuple(whole[p : p + size]), ()):
                todo[k, p - q].add(q)
        best: dict[int, dict[int, int]] = defaultdict(dict)
        for (k, shift), places in todo.items():
            item, known = self.items[k][1], best[k]
            for start in {q - i * size for q in places for i in range(self.budget + 1)}:
                if not 0 <= start <= len(item) - window or known.get(start, window) == 0:
                    continue
                p, wanted = start + shift, item[start : start + window]
                d = 0 if p >= 0 and whole[p : p + window] == wanted else myers(wanted, whole[max(0, p - allowed) : p + window + allowed])
                known[start] = min(known.get(start, window), d)
        out = []
        for k, starts in best.items():
            good = {s: d for s, d in starts.items() if d <= allowed}
            if good:
                least = min(good.values())
                out.append((self.items[k][0], least, sum(d == least for d in good.values()), min(s for s, d in good.items() if d == least)))
        return out


def _hashes(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(grams.shape[1]):
            h = (h ^ (grams[:, j].astype(np.uint64) + np.uint64(1))) * _P
            h ^= h >> np.uint64(29)
    return h


_INDEX: dict = {}


def _index(block: list, window: int, budget: int) -> Index:
    """The index of a broadcast block, made once in each worker."""
    if _INDEX.get("block") is not block or _INDEX.get("for") != (window, budget):
        _INDEX.update({"block": block, "for": (window, budget), "index": Index(block, window, budget)})
    return _INDEX["index"]


def leaks(docs: DataFrame, items: DataFrame, window: int = 10, budget: int = 1, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, passages, first_word: each document and item of which the document holds a passage
    of `window` consecutive words with at most `budget` word edits. distance 0: the words stand there unchanged.

    Null and short texts match nothing; repeated rows of documents give repeated results, repeated items count once
    (by id and text). The items, a set of test texts, are broadcast in blocks of bounded size, so their number has no
    limit; documents are never shuffled. Words as in TESTDATA.md."""
    spark = docs.sparkSession
    own = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null"), "doc_id")
    size = F.coalesce(F.length("text"), F.lit(0)) + 64
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total * 1.3) // block_chars))
    parts = []
    for k in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        kept = spark.sparkContext.broadcast(sorted((r[0], r[1] or "") for r in mine.toLocalIterator()))
        parts.append(_search(own, kept, window, budget))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(own: DataFrame, kept, window: int, budget: int) -> DataFrame:
    def of(b: pa.RecordBatch):
        index = _index(kept.value, window, budget)
        ids = b.column(0).to_pylist()
        rows = [(ids[m[0]], *m[1:]) for m in index.matches(b.column(1).to_pylist(), budget)]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "passages", "first_word"])

    return map_batches(own, of, "doc_id long, item_id long, distance long, passages long, first_word long")
