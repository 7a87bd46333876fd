"""Problem 2: pages with nearly the same text, by an exact set-similarity join over a token-group matrix.

Texts are sets of word shingles (64-bit hashes). Copies form one class. Similar classes are partitioned into groups by
min-hashes; the matrix holds, for each group, its members' tokens (only those tokens that a pair of sufficient
similarity must share at least one of: the rarest of each set). The overlap of a member with those of another group is
bounded from that matrix by sizes, places and bitmaps; only groups that qualify are opened, and their members are
compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, map_batches
from millrace.runtime import ship, spread, stage, unique_by, unstage

#: Tokens are counted in so many buckets, to know the rare from the frequent; a table of fixed size.
BUCKETS = 1 << 16
#: Members of a group, at most; larger groups are divided.
GROUP_SIZE = 32
#: Up to so many ids are broadcast to the texts; beyond, the texts are shuffled to the ids.
BROADCAST_IDS = 2_000_000
#: Tokens of the sets behind a slice of the matrix, about (a third of them are in it); pairs of a slice that are looked at in one step.
SLICE_TOKENS, PAIRS_AT_ONCE = 4_000_000, 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: ASCII letters and digits in lower case, other ASCII as white space, bytes of other characters as they are.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


class _Words(dict):
    """The hash of each word between ASCII separators; several or none, as a tuple, where other characters separate."""

    def __missing__(self, piece: bytes) -> int | tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        if piece.isascii():
            out = xxhash.xxh3_64_intdigest(piece) or 1
        else:
            found = tuple(xxhash.xxh3_64_intdigest(w.lower()) or 1 for w in WORD.findall(piece.decode("utf-8", "surrogatepass")))
            out = found[0] if len(found) == 1 else found
        self[piece] = out
        return out


_KNOWN = _Words()


def _word_hashes(text: str) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    found = list(map(_KNOWN.__getitem__, text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()))
    if not text.isascii():
        found = list(filter(None, found))  # pieces without a word
        if tuple in set(map(type, found)):
            found = [y for x in found for y in (x if type(x) is tuple else (x,))]
    return np.array(found, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int, least_words: int) -> np.ndarray | None:
    """The sorted set of the text's shingles; None if it has fewer words than least_words."""
    w = _word_hashes(text)
    n = len(w) - size + 1
    if len(w) < least_words or n <= 0:
        return None
    h = w[:n].copy()
    for j in range(1, size):
        h = h * _A + w[j : j + n]
    h = _mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def index_length(n: int, t: float) -> int:
    """So many of the rarest of n tokens: a pair of similarity t or more, this set the smaller, shares one of them."""
    return n - _ceil(2 * t / (1 + t) * n) + 1


def probe_length(n: int, t: float) -> int:
    """So many of the rarest of n tokens: a pair of similarity t or more shares one of them."""
    return n - _ceil(t * n) + 1


def _ceil(x: float) -> int:
    return int(np.ceil(x - 1e-9))


def _read(size: int, least: int):
    """Of each text: a 128-bit name of its set and the key of its group; and once a task the counts of the buckets."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids, names, keys, sizes, buckets = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, size, least) if t else None
                if s is None:
                    continue
                ids.append(i)
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(_group_key(s))
                sizes.append(len(s))
                buckets.append(s >> np.uint64(48))
            if buckets:
                counts += np.bincount(np.concatenate(buckets).astype(np.int64), minlength=BUCKETS)
            yield _row(ids, names, keys, sizes, [None] * len(ids))
        if counts.any():
            yield _row([None], [None], [None], [None], [counts.astype("<i8").tobytes()])

    return run


def _row(ids: list, names: list, keys: list, sizes: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary())], ["id", "name", "key", "n", "counts"])


def _sum_tables(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            total += np.frombuffer(x, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def _bucket_counts(tables: DataFrame) -> np.ndarray:
    """The sum of all tables, half a MB each, added in two steps; only one reaches the driver."""
    parts = tables.rdd.getNumPartitions()
    for n in (max(1, int(parts**0.5)), 1):
        tables = tables.mapInArrow(_sum_tables, "counts binary").coalesce(n)
    rows = tables.mapInArrow(_sum_tables, "counts binary").collect()
    return np.frombuffer(rows[0][0], "<i8") if rows else np.zeros(BUCKETS, np.int64)


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens, the rarest first; the same order for all sets."""
    return s[np.lexsort((s, counts[(s >> np.uint64(48)).astype(np.int64)]))]


def _group_key(s: np.ndarray) -> int:
    """Of two min-hashes: similar sets have the same one likely."""
    a, b = int((s * _A).min()), int((s * _B).min())
    return xxhash.xxh3_64_intdigest(a.to_bytes(8, "little") + b.to_bytes(8, "little")) >> 1


def _narrowed(own: DataFrame, few: DataFrame, rows: int) -> DataFrame:
    """The texts of the ids in few, with its other columns. The ids are broadcast if there are not many."""
    return own.join(F.broadcast(few) if rows <= BROADCAST_IDS else few, "id")


def near_duplicates(df: DataFrame, id_col: str = "page_id", text_col: str = "text", size: int = 3, threshold: float = 0.7, least_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """Two tables: links (a, b, overlap, n_a, n_b) between classes whose sets of `size` consecutive words have a Jaccard
    similarity of at least `threshold`, a < b; and members (id, class) of all documents with at least `least_words`
    words. Documents with the same set form one class, named by its smallest id.

    Null, empty and short texts are in neither table; rows repeated with one id count once; whole texts count. No
    candidate is dropped: the number of partners has no cap, groups have a bounded size, frequent tokens stand last in
    every set's order and so rarely lead from group to group. Shuffled are the rare tokens of each class (a third of
    its set, 8 bytes each), its bitmap once a slice, and the sets of groups that qualify."""
    own = spread(unique_by(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null"), "id"), "id")
    spark = own.sparkSession
    ship(spark)
    read = stage(own.mapInArrow(_read(size, least_words), "id long, name binary, key long, n int, counts binary"), "sets")
    kept = spark.sparkContext.broadcast(_bucket_counts(read.where("counts is not null").select("counts")))
    named = read.where("id is not null").select("id", "name", "key")
    classes = named.groupBy("name").agg(F.min("id").alias("class"), F.min("key").alias("key"))
    members = stage(named.join(classes.select("name", "class"), "name").select("id", "class"), "members")
    # groups of about GROUP_SIZE classes at most (a key with more is divided by the class), named by the smallest class
    sized = classes.join(classes.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP_SIZE), "key", "left")
    part = F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / GROUP_SIZE)))
    parted = sized.select("class", "key", part.alias("part"))
    groups = stage(parted.join(parted.groupBy("key", "part").agg(F.min("class").alias("grp"), F.count("*").alias("size")), ["key", "part"]).select("class", "grp", "size"), "groups")
    leaders = groups.count()

    tokens = read.agg(F.sum("n")).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SLICE_TOKENS))
    placed = _narrowed(own, groups.select(F.col("class").alias("id"), "grp"), leaders).select("id", "grp", "text")
    rows = map_batches(placed, lambda b: _matrix(b, size, least_words, threshold, kept.value, slices), "slice int, class long, grp long, n int, places binary, bitmap binary")
    found = rows.repartitionById(slices, "slice").mapInArrow(lambda batches: _qualify(batches, threshold), "g1 long, g2 long")
    pairs = stage(found.distinct(), "pairs")

    needed = pairs.select(F.explode(F.array("g1", "g2")).alias("grp")).union(groups.where("size > 1").select("grp")).distinct()
    open_classes = stage(groups.join(needed, "grp", "left_semi").select(F.col("class").alias("id"), "grp"), "open")
    sets = map_batches(_narrowed(own, open_classes, open_classes.count()).select("id", "grp", "text"), lambda b: _token_sets(b, size, least_words), "grp long, class long, tokens binary")
    blocks = sets.groupBy("grp").agg(F.collect_list(F.struct("class", "tokens")).alias("members"))
    inside = map_batches(blocks.where(F.size("members") > 1).select("members"), lambda b: _inside(b, threshold), _LINK)
    opened = pairs.join(blocks.select(F.col("grp").alias("g1"), F.col("members").alias("m1")), "g1").join(blocks.select(F.col("grp").alias("g2"), F.col("members").alias("m2")), "g2").select("m1", "m2")
    across = map_batches(opened, lambda b: _across(b, threshold), _LINK)
    return inside.unionByName(across), members


_LINK = "a long, b long, overlap int, n_a int, n_b int"


def _sets(members: list[dict]) -> list[tuple[int, np.ndarray]]:
    return [(m["class"], _unpacked(m["tokens"])) for m in members]


def _level(n: int) -> int:
    """Words of 64 bits of the bitmap of a set of n tokens: a power of two, at least a bit a token."""
    return 1 << max(0, (n - 1).bit_length() - 6)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens at each bit. The bits in which two bitmaps differ are at most as many as the
    tokens that only one of the sets has. A bitmap of half the size is the two halves' exclusive or."""
    bits = _level(len(s)) * 64
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def _matrix(b: pa.RecordBatch, size: int, least: int, t: float, counts: np.ndarray, slices: int):
    """The token-group matrix, cut by tokens into slices: for each class and slice its group, the size of its set, the
    rare tokens that fall into the slice, each with its place in the set's order, and the set's bitmap."""
    sizes, heads, lengths, maps = [], [], [], []
    for text in b.column(2).to_pylist():
        s = _ordered(shingles(text, size, least), counts)
        k = probe_length(len(s), t)
        sizes.append(len(s))
        heads.append(s[:k])
        lengths.append(k)
        maps.append(_bitmap(s).tobytes())
    if not sizes:
        return
    head = np.concatenate(heads)
    rec = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(head)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where = ((head >> np.uint64(20)) % np.uint64(slices)).astype(np.int32)
    order = np.lexsort((rec, where))
    both = np.stack([(head >> np.uint64(32)).astype("<u4"), place.astype("<u4")], axis=1)[order]
    where, rec = where[order], rec[order]
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (rec[1:] != rec[:-1])]))
    ends = np.concatenate([first, [len(where)]]).astype(np.int32) * 8
    places = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(both.tobytes())])
    take = pa.array(rec[first])
    yield pa.RecordBatch.from_arrays(
        [pa.array(where[first]), b.column(0).take(take), b.column(1).take(take), pa.array(np.array(sizes, np.int32)).take(take), places, pa.array(maps, pa.binary()).take(take)], ["slice", "class", "grp", "n", "places", "bitmap"]
    )


def _qualify(batches, t: float):
    """Pairs of groups of which two members share a rare token and may be similar enough: by their sizes, by the place
    of the token (what can follow it in both), and by their bitmaps. The member of smaller size (of smaller name, if
    equal) shares one of its index_length rarest tokens, the other one of its probe_length rarest."""
    ids, groups, sizes, places, maps = [], [], [], [], []
    for b in batches:
        ids.append(b.column(1).to_numpy(zero_copy_only=False))
        groups.append(b.column(2).to_numpy(zero_copy_only=False))
        sizes.append(b.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
        places += b.column(4).to_pylist()
        maps += b.column(5).to_pylist()
    if not places:
        return
    rank_of = np.lexsort((np.concatenate(ids), np.concatenate(sizes)))  # by size, then name
    grp, n = np.concatenate(groups)[rank_of], np.concatenate(sizes)[rank_of]
    maps = [maps[i] for i in rank_of]
    own = [np.frombuffer(places[i], "<u4").reshape(-1, 2) for i in rank_of]
    rec = np.repeat(np.arange(len(own)), [len(x) for x in own])
    both = np.concatenate(own)
    order = np.lexsort((rec, both[:, 0]))
    token, pos, rec = both[order, 0], both[order, 1].astype(np.int64), rec[order]
    levels = np.array([_level(int(x)) for x in n])
    table, offset = _bitmap_table(maps, levels)
    short = n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1
    end = np.searchsorted(token, token, "right")
    # partners of an entry: later ones of the same token, no larger than allowed
    reach = np.searchsorted(n, np.floor(n / t + 1e-9).astype(np.int64), "right")  # records up to this rank are not too large
    key = token.astype(np.int64) * (len(n) + 1) + rec
    last = np.minimum(end, np.searchsorted(key, token.astype(np.int64) * (len(n) + 1) + reach[rec], "left"))
    many = np.where(pos < short[rec], np.maximum(0, last - np.arange(len(token)) - 1), 0)
    total = np.cumsum(many)
    start, seen = 0, []
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        part = many[start:stop]
        i = np.repeat(np.arange(start, stop), part)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        start = stop
        x, y = rec[i], rec[j]
        need = np.ceil(t / (1 + t) * (n[x] + n[y]) - 1e-9)
        good = (grp[x] != grp[y]) & (1 + np.minimum(n[x] - pos[i] - 1, n[y] - pos[j] - 1) >= need)
        x, y, need = x[good], y[good], need[good]
        good = _differ(table, offset, levels, x, y) <= n[x] + n[y] - 2 * need
        a, c = grp[x[good]], grp[y[good]]
        if len(a):
            seen.append(np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)]), axis=1))
    if seen:
        out = np.unique(np.concatenate(seen, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["g1", "g2"])


def _bitmap_table(maps: list[bytes], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bitmaps in one array, each followed by its folded form; where each begins."""
    parts, offset, at = [], np.zeros(len(maps), np.int64), 0
    for i, (m, k) in enumerate(zip(maps, levels.tolist())):
        x = np.frombuffer(m, np.uint64)
        offset[i] = at
        parts.append(x)
        at += k
        if k > 1:
            parts.append(x[: k // 2] ^ x[k // 2 :])
            at += k // 2
    return np.concatenate(parts), offset


def _differ(table: np.ndarray, offset: np.ndarray, levels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of x and y differ, at the size of the smaller one; at most twice as large is the
    other, as their sets' sizes are close; 0 where it is larger still."""
    out = np.zeros(len(x), np.int64)
    a, b = levels[x], levels[y]
    low = np.minimum(a, b)
    for k in np.unique(low).tolist():
        at = np.flatnonzero((low == k) & (np.maximum(a, b) <= 2 * k))
        p = offset[x[at]] + np.where(a[at] > k, a[at], 0)
        q = offset[y[at]] + np.where(b[at] > k, b[at], 0)
        bits = np.zeros(len(at), np.int64)
        for w in range(k):
            bits += np.bitwise_count(table[p + w] ^ table[q + w])
        out[at] = bits
    return out


def _token_sets(b: pa.RecordBatch, size: int, least: int):
    """The sets as sorted tokens of six bytes: two sets of a thousand tokens agree in a wrong one with odds of 1 : 10^8."""
    sets = [_packed(shingles(t, size, least)) for t in b.column(2).to_pylist()]
    yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(sets, pa.binary())], ["grp", "class", "tokens"])


def _packed(s: np.ndarray) -> bytes:
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The number of common tokens of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _link(out: tuple[list, ...], p: int, x: np.ndarray, q: int, y: np.ndarray, t: float) -> None:
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small < _ceil(t * large):
        return
    common = _overlap(x, y)
    if common >= t * (len(x) + len(y) - common) - 1e-9:
        row = (p, q, common, len(x), len(y)) if p < q else (q, p, common, len(y), len(x))
        for col, v in zip(out, row):
            col.append(v)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["a", "b", "overlap", "n_a", "n_b"])


def _inside(b: pa.RecordBatch, t: float):
    """The links within a group."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for members in b.column(0).to_pylist():
        sets = _sets(members)
        for i, (p, x) in enumerate(sets):
            for q, y in sets[i + 1 :]:
                _link(out, p, x, q, y, t)
    yield _batch(out)


def _across(b: pa.RecordBatch, t: float):
    """The links between two groups: a set is compared with the other group's members only if its overlap with the
    union of their tokens could be enough."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for m1, m2 in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        one, two = _sets(m1), _sets(m2)
        union = np.unique(np.concatenate([y for _, y in two])) if len(two) > 1 else None
        for p, x in one:
            if union is not None and _overlap(x, union) < _ceil(t * len(x)):
                continue
            for q, y in two:
                _link(out, p, x, q, y, t)
    yield _batch(out)


def duplicate_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, class, near_class, n_links: for each document its class of copies, the smallest class connected to it by
    links, and the number of links of its class.

    Connected components by alternating large-star and small-star steps, each a grouped minimum; the edges are
    written to the shared folder in each round, until a round changes nothing (after some log2 of the longest path);
    the table of the round before is then removed."""
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, before = stage(small, "edges"), edges
        unstage(before)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    root = edges.groupBy(F.col("u").alias("class")).agg(F.min("v").alias("near_class"))
    return members.join(degree, "class", "left").join(root, "class", "left").select("id", "class", F.coalesce("near_class", "class").alias("near_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def document_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: each pair of documents, in one class or in linked classes. As many rows as there are pairs."""
    m = members
    linked = links.select("a", "b").join(m.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    copies = m.select("class", F.col("id").alias("x")).join(m.select("class", F.col("id").alias("y")), "class").where("x < y").select("x", "y")
    return copies.unionAll(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
