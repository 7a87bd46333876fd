"""Dictionaries of any size against texts: which terms a text holds, by one automaton over each block of terms.

A block of terms of bounded size is broadcast; larger dictionaries are searched block after block in the same tasks, so
the rows are the same for every number of terms and no text is shuffled."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import ship

#: Terms of one block; about 100 bytes each in a broadcast.
BLOCK_TERMS = 200_000


class Automaton:
    """All terms that occur in a text, in one pass over it, whatever their number."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        try:
            import ahocorasick
        except ImportError:
            self._compiled = None
            self._build()
            return
        self._compiled = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self._compiled.add_word(t, i)
        if terms:
            self._compiled.make_automaton()

    def _build(self) -> None:
        self._next, self._fail, self._ends = [{}], [0], [[]]
        for i, t in enumerate(self.terms):
            at = 0
            for c in t:
                if c not in self._next[at]:
                    self._next[at][c] = len(self._next)
                    self._next.append({})
                    self._fail.append(0)
                    self._ends.append([])
                at = self._next[at][c]
            self._ends[at].append(i)
        todo = deque(self._next[0].values())
        while todo:
            at = todo.popleft()
            for c, nxt in self._next[at].items():
                back = self._fail[at]
                while back and c not in self._next[back]:
                    back = self._fail[back]
                self._fail[nxt] = self._next[back].get(c, 0)
                self._ends[nxt] = self._ends[nxt] + self._ends[self._fail[nxt]]
                todo.append(nxt)

    def held(self, text: str) -> set[int]:
        """The numbers of the terms that the text holds."""
        if not self.terms:
            return set()
        if self._compiled is not None:
            return {i for _, i in self._compiled.iter(text)}
        at, out = 0, set()
        for c in text:
            while at and c not in self._next[at]:
                at = self._fail[at]
            at = self._next[at].get(c, 0)
            out.update(self._ends[at])
        return out


_MADE: dict = {}


def _made(rows: list, make: Callable[[list], object]):
    """What make builds of a broadcast list, once in each worker."""
    key = (id(rows), make)
    if key not in _MADE:
        if len(_MADE) > 8:
            _MADE.clear()
        _MADE[key] = (rows, make(rows))
    return _MADE[key][1]


def scan(df: DataFrame, terms: DataFrame, order: list[str], make: Callable[[list], object], step: Callable, columns: list[T.StructField], block_terms: int = BLOCK_TERMS) -> DataFrame:
    """df with columns, after each row went through step(made, row values of the last columns of df, own values so far)
    for each block of terms. The column _text of df is searched and dropped in the end.

    made is what make builds of a block's rows; columns start as null."""
    ship(df.sparkSession)
    names = [c.name for c in columns]
    n = terms.count()
    blocks = max(1, -(-n // block_terms))
    work = df.withColumns({c.name: F.lit(None).cast(c.dataType) for c in columns})
    kinds = [pa.list_(pa.string()) if isinstance(c.dataType, T.ArrayType) else pa.string() for c in columns]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in work.schema.fields])
    at = work.columns.index("_text")
    first = len(work.columns) - len(columns)
    for k in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64(terms.columns[0]), F.lit(blocks)) == k) if blocks > 1 else terms
        kept = df.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.orderBy(*order).toLocalIterator()])

        def run(batches, kept=kept):
            made = _made(kept.value, make)
            for b in batches:
                own = [b.column(first + j).to_pylist() for j in range(len(columns))]
                out = [step(made, t, tuple(o[i] for o in own)) for i, t in enumerate(b.column(at).to_pylist())]
                cols = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns[:first], *cols], names=b.schema.names)

        work = work.mapInArrow(run, schema)
    return work.drop("_text").select(*[c for c in df.columns if c != "_text"], *names)


def _automaton(rows: list) -> Automaton:
    return Automaton([r[0] for r in rows])


def _add_held(a: Automaton, text: str | None, own: tuple) -> tuple:
    found = [a.terms[i] for i in a.held(text)] if text else []
    return (sorted([*(own[0] or ()), *found]),)


def held_terms(df: DataFrame, text: Column, terms: DataFrame, out: str = "held", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """df with the array out of the distinct terms (first column of terms, any number; empty ones don't count) that
    text holds, in order; none for a null text."""
    own = terms.select(F.col(terms.columns[0]).alias("term")).where("term <> ''").distinct()
    return scan(df.withColumn("_text", text), own, ["term"], _automaton, _add_held, [T.StructField(out, T.ArrayType(T.StringType()))], block_terms)


class _Aliases:
    """Aliases (alias, program, ord): the first one held, and the first of several words all of which are held."""

    def __init__(self, rows: list) -> None:
        self.rows = sorted(rows, key=lambda r: r[2])
        self.whole = Automaton([r[0] for r in self.rows])
        self.of: dict[str, list[int]] = {}
        self.sizes: dict[int, int] = {}
        for k, r in enumerate(self.rows):
            words = set(r[0].split())
            if len(r[0].split()) > 1:
                self.sizes[k] = len(words)
                for w in words:
                    self.of.setdefault(w, []).append(k)
        self.words = Automaton(sorted(self.of))

    def step(self, text: str, own: tuple) -> tuple:
        best = []
        whole = self.whole.held(text)
        best.append(min(whole, default=None))
        second = None
        if not whole and own[0] is None:
            count: dict[int, int] = {}
            for w in self.words.held(text):
                for k in self.of[self.words.terms[w]]:
                    count[k] = count.get(k, 0) + 1
            second = min((k for k, n in count.items() if n == self.sizes[k]), default=None)
        best.append(second)
        out = list(own)
        for j, k in enumerate(best):
            if k is not None and (out[2 * j] is None or self.rows[k][2] < out[2 * j]):
                out[2 * j], out[2 * j + 1] = self.rows[k][2], self.rows[k][1]
        return tuple(out)


def _alias_step(a: _Aliases, text: str | None, own: tuple) -> tuple:
    return a.step(text, own) if text else own


def first_aliases(df: DataFrame, text: Column, aliases: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """df with o1, p1 (order and program of the first alias that text holds) and o2, p2 (of the first alias of several
    words all of which it holds somewhere; looked for only in rows without p1)."""
    cols = [T.StructField(c, T.StringType()) for c in ("o1", "p1", "o2", "p2")]
    return scan(df.withColumn("_text", text), aliases.select("alias", "program_id", "ord").where("alias <> ''"), ["ord"], _Aliases, _alias_step, cols, block_terms)


class _Contained:
    """Aliases that hold a name or are held by it."""

    def __init__(self, rows: list) -> None:
        self.rows = sorted(rows, key=lambda r: r[2])
        self.automaton = Automaton([r[0] for r in self.rows])
        self.all, self.starts, at = "\n".join(r[0] for r in self.rows), [], 0
        for r in self.rows:
            self.starts.append(at)
            at += len(r[0]) + 1


def _contained_step(c: _Contained, name: str | None, own: tuple) -> tuple:
    if not name:
        return own
    best = min(c.automaton.held(name), default=None)
    at = c.all.find(name)
    if at >= 0:
        k = bisect_right(c.starts, at) - 1
        best = k if best is None else min(best, k)
    if best is not None and (own[0] is None or c.rows[best][2] < own[0]):
        return c.rows[best][2], c.rows[best][1]
    return own


def first_contained(df: DataFrame, name: Column, aliases: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """df with o, p: order and program of the first alias that the name holds or that holds the name."""
    cols = [T.StructField(c, T.StringType()) for c in ("o", "p")]
    return scan(df.withColumn("_text", name), aliases.select("alias", "program_id", "ord").where("alias <> ''"), ["ord"], _Contained, _contained_step, cols, block_terms)
