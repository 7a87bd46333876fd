"""Problem 3: lines that a source repeats over many of its documents.

Two operators. cut_chunks takes whole texts, without regard to lines: content-defined chunks by a rolling hash, distinct
documents counted for each chunk and source, chunks repeated excessively cut out. repeated_lines finds lines: there
chunks stay within a line, a line all of whose chunks are repeated is a candidate, and its own documents are then
counted exactly."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import county_key, map_batches
from millrace.runtime import spread, stage, unique_by

_SPACE = re.compile("[ \t\r ]{2,}|[\t\r ]")
_DIGITS = re.compile("[0-9]+")
_WINDOW = 32
_MASK = np.uint32(0x3F << 26)  # a cut about every 64 bytes
_RANDOM = np.random.default_rng(20240501)
_GEAR = _RANDOM.integers(0, 2**32, 256, dtype=np.uint32)
_LETTER = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
#: Up to so many repeated chunks are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_CHUNKS = 2_000_000


def normal_text(text: str) -> str:
    """The text with all lines normalised, but for a space that may be left at an end of a line."""
    return _DIGITS.sub("#", _SPACE.sub(" ", text).lower())


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the last 32 bytes at each place: the sum of gear values, each shifted by its distance."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(_BASE, k, 1 << 64))
        k *= 2
    return out


def chunk_texts(texts: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all non-blank lines of the texts: number of the text, number of the line (from 1), number of chunks; and the
    hashes of all chunks in order, which hold the text's salt.

    Within a line, chunks end where the rolling hash of the 32 bytes before has a certain value. All 32 lie in the
    line, so a line has the same chunks wherever it stands."""
    coded = [normal_text(t).encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_of = np.searchsorted(np.cumsum([len(c) for c in coded]), starts, "right")
    first = np.searchsorted(text_of, np.arange(len(texts)))
    line_no = np.arange(len(starts)) - first[text_of] + 1
    starts = starts + ((ends > starts) & (data[starts] == 32))
    ends = ends - ((ends > starts) & (data[ends - 1] == 32))
    full = ends > starts
    starts, ends, text_of, line_no = starts[full], ends[full], text_of[full], line_no[full]
    if not len(starts):
        return text_of, line_no, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cuts = np.flatnonzero((rolling(data) & _MASK) == 0) + 1
    line_of = np.searchsorted(starts, cuts, "right") - 1
    inside = (line_of >= 0) & (cuts >= starts[line_of] + _WINDOW) & (cuts < ends[line_of])
    at = np.concatenate([ends, cuts[inside]])  # where chunks end
    owner = np.concatenate([np.arange(len(ends)), line_of[inside]])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    begins = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), starts[owner], np.concatenate([[0], at[:-1]]))
    power = _powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[data] * power)])
    # the value of a chunk is that of its letters, whatever its place: divide by the power at which it begins
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    inverse = _inverse_powers(begins, back)
    h = (total[at] - total[begins]) * inverse + (at - begins).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31)) ^ salts[text_of[owner]]) * _MIX
    h ^= h >> np.uint64(29)
    return text_of, line_no, np.bincount(owner, minlength=len(starts)), h


def _inverse_powers(exponents: np.ndarray, back: np.uint64) -> np.ndarray:
    out, base, left = np.ones(len(exponents), np.uint64), int(back), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(base), out)
        base = base * base % (1 << 64)
        left = left >> np.uint64(1)
    return out


def _line_hashes(chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each line from its chunks in order."""
    if not len(counts):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(counts) - counts
    place = np.arange(len(chunks)) - np.repeat(begins, counts)
    x = (chunks ^ (place.astype(np.uint64) * _MIX)) * np.uint64(_BASE)
    return np.add.reduceat(x ^ (x >> np.uint64(32)), begins)


def _salts(sources: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.encode()) for s in sources], np.uint64)


def _chunks(b: pa.RecordBatch):
    rows = [(i, s, t) for i, s, t in zip(*(b.column(k).to_pylist() for k in range(3))) if t]
    ids, sources, texts = (list(c) for c in zip(*rows)) if rows else ([], [], [])
    n = len(texts)
    text_of, line_no, counts, hashes = chunk_texts(texts, _salts(sources))
    lines = np.bincount(text_of, minlength=n) if n else np.zeros(0, np.int64)
    chunks = np.bincount(np.repeat(text_of, counts), minlength=n) if n else lines
    ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.ListArray.from_arrays(ends(lines), pa.array(line_no.astype(np.int32))), pa.ListArray.from_arrays(ends(lines), pa.array(counts.astype(np.int32))), pa.ListArray.from_arrays(ends(chunks), pa.array(hashes.view(np.int64)))],
        ["id", "source", "line_no", "counts", "chunks"],
    )


def repeated_lines(df: DataFrame, id_col: str = "page_id", text_col: str = "text", source_col: str = "county", least_docs: int = 5, least_share: float = 0.15, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """id, line_no (from 1) of each occurrence of a line that is repeated in its source (see TESTDATA.md, p3_found).

    Rows with a null source are left out, null texts count as documents without lines, rows repeated with the same
    id count once. An empty table gives no rows. Texts are read once: their chunk hashes, a fraction of their size,
    are staged. Hot sources: chunks are counted in each task before the shuffle and by (source, chunk), so no task
    gets a whole source."""
    lines, exact = _occurrences(df, id_col, text_col, source_col, least_docs, least_share, broadcast_chunks)
    return lines.join(exact, ["source", "line"], "left_semi").select("id", "line_no")


def _occurrences(df: DataFrame, id_col: str, text_col: str, source_col: str, least_docs: int, least_share: float, broadcast_chunks: int) -> tuple[DataFrame, DataFrame]:
    """source, id, line_no, line (a hash that holds the source) of the candidates; source, line of the repeated lines."""
    own = df.select(F.col(id_col).cast("long").alias("id"), county_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    own = spread(unique_by(own, "id").where("source is not null and id is not null"), "id")
    sizes = own.groupBy("source").agg(F.count("*").alias("docs")).select("source", F.greatest(F.lit(least_docs), F.ceil(F.col("docs") * least_share - F.lit(1e-9))).alias("least"))
    cut = stage(map_batches(own, _chunks, "id long, source string, line_no array<int>, counts array<int>, chunks array<long>"), "chunks")
    counted = cut.select("source", F.explode(F.array_distinct("chunks")).alias("chunk")).groupBy("source", "chunk").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    hot = stage(counted.join(sizes, "source").where("n >= least").select("chunk").distinct(), "hot")
    lines = stage(_candidates(cut, hot, broadcast_chunks), "lines")
    return lines, lines.groupBy("source", "line").agg(F.countDistinct("id").alias("n")).join(sizes, "source").where("n >= least").select("source", "line")


def _candidates(cut: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """source, id, line_no, line (hash) of the lines all of whose chunks are in hot."""
    schema, names = "source string, id long, line_no long, line long", ["source", "id", "line_no", "line"]
    if hot.count() <= most:
        kept = cut.sparkSession.sparkContext.broadcast(np.sort(hot.toPandas()["chunk"].to_numpy(np.int64)))
        known = lambda chunks: np.isin(chunks, kept.value)
        return map_batches(cut, lambda b: _select_lines(b, known, names), schema)
    every = map_batches(cut, _each_chunk, schema + ", n_chunks long, chunk long")
    found = every.join(hot, "chunk", "left_semi").groupBy(*names, "n_chunks").agg(F.count("*").alias("n"))
    return found.where("n = n_chunks").select(*names)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, line number, number of chunks and hash of each line, and all chunks."""
    counts, chunks = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.column(4).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
    return row, b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, _line_hashes(chunks.view(np.uint64), counts).view(np.int64), chunks


def _select_lines(b: pa.RecordBatch, known, names: list[str]):
    row, line_no, counts, line, chunks = _flat(b)
    if len(counts):
        good = np.add.reduceat(known(chunks).astype(np.int64), np.cumsum(counts) - counts) == counts
        row, line_no, line = row[good], line_no[good], line[good]
    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), b.column(0).take(pa.array(row)), pa.array(line_no), pa.array(line)], names)


def _each_chunk(b: pa.RecordBatch):
    row, line_no, counts, line, chunks = _flat(b)
    place = np.repeat(np.arange(len(row)), counts)
    take = pa.array(row[place])
    yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(0).take(take), pa.array(line_no[place]), pa.array(line[place]), pa.array(counts[place]), pa.array(chunks)], ["source", "id", "line_no", "line", "n_chunks", "chunk"])


#: Of the texts' bytes: capitals as small letters, digits as #, white space as a space; all of one length.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isupper() else 35 if 48 <= b < 58 else 32 if b in (9, 10, 13) else b for b in range(256))
_CHUNK_WINDOW, _CHUNK_MASK = 16, np.uint32(0x1F << 27)  # a cut about every 32 bytes


def chunk_ends(text: str) -> tuple[bytes, bytes, list[int]]:
    """The text's bytes, as they are and folded, and where its content-defined chunks end: behind 16 bytes whose rolling
    hash has a certain value (and behind the character that this may lie in). Lines don't matter."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    data = np.frombuffer(folded, np.uint8)
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    ends = np.flatnonzero((h & _CHUNK_MASK) == 0) + 1
    ends = ends[(ends >= _CHUNK_WINDOW) & (ends < len(data))]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(starts, ends)
    ends = np.unique(starts[at[at < len(starts)]])
    return raw, folded, [*ends.tolist(), len(data)] if len(data) else []


def _chunk_names(folded: bytes, ends: list[int], salt: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(folded[a:b], salt) >> 1 for a, b in zip([0, *ends], ends)]


def _without(raw: bytes, ends: list[int], gone) -> tuple[str, int]:
    """The text without the chunks at these places, and how many characters went."""
    out = b"".join(raw[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in gone).decode("utf-8", "surrogatepass")
    return out, len(raw.decode("utf-8", "surrogatepass")) - len(out)


def cut_chunks(df: DataFrame, id_col: str = "page_id", text_col: str = "text", source_col: str = "county", least_docs: int = 5, least_share: float = 0.15, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """id, text, cut_chars: each text without the chunks that stand in at least `least_docs` documents and `least_share` of
    the documents of its source.

    A passage repeated with the same words is cut but for its ends, up to a chunk (some 32 bytes) on each side, wherever
    it stands and whether lines end in it or not. Rows with a null source keep their text, null texts stay null and
    count as documents, rows repeated with one id count once. Shuffled are chunk names (8 bytes each), counted in each
    task first; texts only if more than `broadcast_chunks` chunks are repeated, when places are joined to them."""
    own = df.select(F.col(id_col).cast("long").alias("id"), county_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    own = spread(unique_by(own, "id"), "id")
    sourced = own.where("source is not null and id is not null")
    sizes = sourced.groupBy("source").agg(F.count("*").alias("docs")).select("source", F.greatest(F.lit(least_docs), F.ceil(F.col("docs") * least_share - F.lit(1e-9))).alias("least"))

    def names_of(source: str | None, text: str | None) -> tuple[bytes, list[int], list[int]]:
        raw, folded, ends = chunk_ends(text or "")
        return raw, ends, _chunk_names(folded, ends, xxhash.xxh3_64_intdigest(source.encode())) if source is not None else []

    def chunks(b: pa.RecordBatch):
        found = [names_of(s, t)[2] for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "source", "chunks"])

    cut = stage(map_batches(sourced, chunks, "id long, source string, chunks array<long>"), "chunks")
    counted = cut.select("source", F.explode(F.array_distinct("chunks")).alias("chunk")).groupBy("source", "chunk").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    hot = stage(counted.join(sizes, "source").where("n >= least").select("chunk").distinct(), "hot")
    schema = "id long, text string, cut_chars long"

    def rows(ids, kept):
        return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.int64())], ["id", "text", "cut_chars"])

    if hot.count() <= broadcast_chunks:
        kept = cut.sparkSession.sparkContext.broadcast(frozenset(hot.toPandas()["chunk"].tolist()))

        def of(b: pa.RecordBatch):
            out = []
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, ends, names = names_of(s, t)
                gone = {k for k, n in enumerate(names) if n in kept.value}
                out.append(_without(raw, ends, gone) if gone else (t, 0))
            yield rows(b.column(0), out)

        return map_batches(own, of, schema)
    places = cut.select("id", F.posexplode("chunks").alias("place", "chunk")).join(hot, "chunk", "left_semi").groupBy("id").agg(F.collect_list("place").alias("gone"))

    def at(b: pa.RecordBatch):
        out = []
        for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw, _, ends = chunk_ends(t or "")
            out.append(_without(raw, ends, set(gone)) if gone else (t, 0))
        yield rows(b.column(0), out)

    return map_batches(own.join(places, "id", "left").select("id", "text", "gone"), at, schema)


def remove_lines(df: DataFrame, lines: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, text without the given (id, line_no). A text that loses no line stays as it is, a null text stays null."""
    gone = lines.groupBy("id").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.when(F.array_contains("gone", i + 1), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return own.join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def clean_texts(df: DataFrame, id_col: str = "page_id", text_col: str = "text", source_col: str = "county", least_docs: int = 5, least_share: float = 0.15, broadcast_lines: int = BROADCAST_CHUNKS) -> DataFrame:
    """id, text without the lines that repeated_lines finds. Rows with a null source and texts that lose no line stay as
    they are, null texts stay null, repeated rows give repeated results.

    The hashes of the repeated lines (8 bytes each) are broadcast and texts are cleaned where they lie; only with more of
    them than `broadcast_lines` the occurrences are joined to the texts by id."""
    lines, exact = _occurrences(df, id_col, text_col, source_col, least_docs, least_share, BROADCAST_CHUNKS)
    hashes = stage(exact, "repeated")
    if hashes.count() > broadcast_lines:
        return remove_lines(df, lines.join(hashes, ["source", "line"], "left_semi").select("id", "line_no"), id_col, text_col)
    kept = df.sparkSession.sparkContext.broadcast(np.sort(hashes.select("line").toPandas()["line"].to_numpy(np.int64)))

    def of(b: pa.RecordBatch):
        sources, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
        at = [k for k, (s, t) in enumerate(zip(sources, texts)) if s is not None and t]
        text_of, line_no, counts, chunks = chunk_texts([texts[k] for k in at], _salts([sources[k] for k in at]))
        hit = np.isin(_line_hashes(chunks, counts).view(np.int64), kept.value)
        gone: dict[int, set[int]] = {}
        for k, no in zip(text_of[hit].tolist(), line_no[hit].tolist()):
            gone.setdefault(at[k], set()).add(no)
        for k, numbers in gone.items():
            texts[k] = "\n".join(x for no, x in enumerate(texts[k].split("\n"), 1) if no not in numbers)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    own = df.select(F.col(id_col).cast("long").alias("id"), county_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return map_batches(spread(own, "id"), of, "id long, text string")
