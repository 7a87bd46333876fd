"""Problem 7: values typed freely, mapped to the entries of a reference list.

The names of all entries hang in a BK-tree under edit distance (a true metric), which yields every name within a
threshold by the triangle inequality. Reference lists larger than a bound are split into shards, each with a tree of
its own. What a shard finds depends on the value and a name alone, and candidates have a total order, so the winners of
the shards merge to the same entry whatever the size of a shard."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import STAND_INS, map_batches

UNMATCHED = "UNMATCHED"
#: Names in one shard, about; a shard is what a task holds at a time.
SHARD_NAMES = 20_000
_SHORT = {"svc": "service", "svcs": "services", "prgm": "program", "pgm": "program", "ctr": "center", "natl": "national", "mgmt": "management", "dept": "department"}
_TAIL = re.compile(r"\s+-\s+[^-]*$|\s*/\s+\S.*$|\s+of\s+[A-Z][^,]*$", re.S)
_HEAD = re.compile(r"^(?:[•*·▪-]\s*|\d{1,2}[.)]\s+|new!\s*|the\s+|our\s+|a\s+)+", re.I)


def distance(a: str, b: str) -> int:
    """Edit distance (insert, delete, replace), bit-parallel over a."""
    return _from(_places(a), len(a), b)


def _places(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _from(places: dict[str, int], m: int, b: str) -> int:
    """The distance of a text of m letters at these places to b."""
    if not m:
        return len(b)
    get, full, top, pv, mv, score = places.get, (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    for c in b:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        pv, mv = (mh << 1) & full | ~(xv | ph) & full, ph & xv
    return score


def _letters(name: str) -> int:
    """How often it has each letter (by residue, up to six times), in unary: an edit takes one letter away at most and
    brings one in at most."""
    count: dict[int, int] = {}
    out = 0
    for c in name:
        k = ord(c) % 61
        n = count[k] = count.get(k, 0) + 1
        if n <= 6:
            out |= 1 << 6 * k + n - 1
    return out


class BKTree:
    """Nodes are [name, {distance: child}, letters, greatest distance of a child]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, name: str) -> None:
        if self.root is None:
            self.root = [name, {}, _letters(name), -1]
            return
        node = self.root
        while d := distance(name, node[0]):
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [name, {}, _letters(name), -1]
                node[3] = max(node[3], d)
                return
            node = nxt

    def within(self, name: str, most: int) -> list[tuple[int, str]]:
        """(distance, name) of every name at most so far away. A node farther by its letters or its length than it and
        all its children could matter is left without a comparison."""
        out, todo, own, size, places = [], [self.root] if self.root else [], _letters(name), len(name), _places(name)
        while todo:
            node = todo.pop()
            both = node[2] & own
            if max((node[2] ^ both).bit_count(), (own ^ both).bit_count()) > most + max(node[3], 0):
                continue
            d = _from(places, size, node[0])
            if d <= most:
                out.append((d, node[0]))
            todo.extend(k for e, k in node[1].items() if d - most <= e <= d + most)
        return sorted(out)


def fold(text: str) -> str:
    """Lower case without accents; everything but letters and digits is one space; & is "and"."""
    t = unicodedata.normalize("NFKD", text.replace("&", " and ")).lower()
    return " ".join(re.findall(r"[^\W_]+", "".join(c for c in t if not unicodedata.combining(c))))


def _skeleton(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def _words(raw: str) -> list[tuple[str, bool]]:
    """The folded words, each with whether a point follows; common short forms are written out."""
    out = []
    for m in re.finditer(r"([^\W_]+)(\.?)", unicodedata.normalize("NFKD", raw.replace("&", " and ")).lower()):
        w = "".join(c for c in m[1] if not unicodedata.combining(c))
        out.append((_SHORT.get(w, w), bool(m[2]) and w not in _SHORT))
    return out


def _bare(words: list[str]) -> str:
    """The words without the vowels behind their first letter; short words stay."""
    return " ".join(_skeleton(w) if len(w) > 4 else w for w in words)


def readings(value: str) -> list[str]:
    """What the value may say, the plainest first: without marks in front, remarks in brackets, places behind;
    with the words before and behind a comma exchanged, with the first or last word moved to the other end."""
    plain = re.sub(r"[_\s\u00a0]+", " ", value).strip()
    bare = re.sub(r"\([^()]*\)?|\[[^\]]*\]", " ", plain).strip() or plain
    forms: list[str] = []
    for x in (plain, bare):
        x = _HEAD.sub("", x)
        forms.append(x)
        cut = x
        while (shorter := _TAIL.sub("", cut).strip()) and shorter != cut:
            cut = shorter
            forms.append(cut)
        if " - " in x:
            forms.append(x.split(" - ", 1)[1])
    for x in list(forms):
        if x.count(",") == 1:
            a, b = x.split(",")
            forms.append(f"{b.strip()} {_HEAD.sub('', a.strip())}")
    for x in list(forms):
        w = x.replace(",", " ").split()
        if len(w) > 1:
            forms.append(" ".join([*w[1:], w[0]]))
            forms.append(" ".join([w[-1], *w[:-1]]))
    return list(dict.fromkeys(f for f in forms if f))


#: A candidate: stage (equal, near, near with exchanged letters, abbreviated), distance, number of the reading, name, entry.
Found = tuple[int, int, int, str, str]


class Matcher:
    """The names of a list or a shard of it: (entry id, name, is acronym)."""

    def __init__(self, names: list[tuple[str, str, bool]]) -> None:
        self.exact: dict[str, str] = {}
        self.acronyms: dict[str, str] = {}
        self.tree = BKTree()
        for entry, name, acronym in names:
            of, key = (self.acronyms, re.sub(r"\W", "", name).lower()) if acronym else (self.exact, fold(name))
            if key:
                of[key] = min(entry, of.get(key, entry))
        self.by_bare: dict[str, list[str]] = {}
        self.by_initials: dict[str, list[str]] = {}
        for key in sorted(self.exact):
            self.tree.add(key)
            words = key.split(" ")
            self.by_bare.setdefault(_bare(words), []).append(key)
            self.by_initials.setdefault("".join(w[0] for w in words), []).append(key)

    def find(self, value: str) -> Found | None:
        """The best candidate; each stage is tried only if those before give none."""
        own = readings(value)
        folded = [fold(x) for x in own]
        if found := [(0, 0, 2 * i, k, self.exact[k]) for i, k in enumerate(folded) if k in self.exact] + self._acronyms(own):
            return min(found)
        return self._near(own, folded) or self._with_swaps(folded) or self._abbreviated(own)

    def _acronyms(self, own: list[str]) -> list[Found]:
        keys = [re.sub(r"[\W_]", "", x).lower() for x in own]
        return [(0, 0, 2 * i + 1, k, self.acronyms[k]) for i, k in enumerate(keys) if k in self.acronyms]

    def _near(self, own: list[str], folded: list[str]) -> Found | None:
        """Within reach by edit distance, as typed or with short forms written out; or equal but for left-out vowels."""
        best: Found | None = None
        seen = set()
        for i, x in enumerate(own):
            words = [w for w, _ in _words(x)]
            for j, key in enumerate((folded[i], " ".join(words))):
                if key in seen or not key:
                    continue
                seen.add(key)
                at = 2 * i + j
                most = reach(len(key)) if best is None else min(reach(len(key)), best[1])
                found = [(1, d, at, name, self.exact[name]) for d, name in self.tree.within(key, most)] if most else []
                if key in self.exact:
                    found.append((1, 0, at, key, self.exact[key]))
                found += [(1, distance(key, name), at, name, self.exact[name]) for name in self.by_bare.get(_bare(words), ())]
                best = min([*found, *([best] if best else [])], default=None)
        return best

    def _with_swaps(self, folded: list[str]) -> Found | None:
        """The closest entry if two letters exchanged count as one edit, not two: the tree gives all names within one
        edit more, those are compared again."""
        found = []
        for i, key in ((folded.index(k), k) for k in dict.fromkeys(folded)):
            if most := reach(len(key)):
                found += [(2, d, i, name, self.exact[name]) for d, name in self.tree.within(key, most + 1) if swaps(key, name) < max(most, 2)]
        return min(found, default=None)

    def _abbreviated(self, own: list[str]) -> Found | None:
        """The closest entry among those with the same first letters once abbreviated words are written out as theirs: a
        word without its vowels, or, with a point, one that begins like the entry's word, with or without its vowels. One word at least must be such, the
        rest must be within reach, an exchange of letters as one edit."""
        found = []
        for i, x in enumerate(own):
            words = _words(x)
            for name in self.by_initials.get("".join(w[0] for w, _ in words), ()):
                full, short = [], False
                for (w, cut), f in zip(words, name.split(" ")):
                    bare = w != f and len(f) > 4 and _skeleton(f) == w
                    begins = cut and w != f and (_skeleton(f).startswith(w) or min(swaps(w, f[: len(w) + k]) for k in (-1, 0, 1)) <= (len(w) > 2))
                    full.append(f if bare or begins else w)
                    short |= bare or begins
                if short and (d := swaps(" ".join(full), name)) <= reach(len(name)):
                    found.append((3, d, i, name, self.exact[name]))
        return min(found, default=None)


def swaps(a: str, b: str) -> int:
    """Edit distance in which the exchange of two neighbours is one edit."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            v = min(nxt[-1] + 1, row[j + 1] + 1, row[j] + (x != y))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                v = min(v, before[j - 1] + 1)
            nxt.append(v)
        before, row = row, nxt
    return row[-1]


def reach(length: int) -> int:
    """The greatest distance at which a name of this length still counts as meant; under four letters only equality."""
    return 0 if length < 4 else 1 if length < 5 else 2 if length < 10 else 3 if length < 18 else 4 if length < 26 else 5


_MATCHER: dict = {}


def _matcher(names: list) -> Matcher:
    """The matcher of a broadcast shard, made once in a worker; the one before it is dropped."""
    if _MATCHER.get("names") is not names:
        _MATCHER.update({"names": names, "matcher": Matcher(names)})
    return _MATCHER["matcher"]


_FOUND = "value string, stage int, distance int, reading int, name string, entry_id string"


def _search(values: DataFrame, kept) -> DataFrame:
    """The best candidate of one shard for each value that has one there."""

    def of(b: pa.RecordBatch):
        matcher = _matcher(kept.value)
        rows = [(v, *found) for v in b.column(0).to_pylist() if (found := matcher.find(v))]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["value", "stage", "distance", "reading", "name", "entry_id"])

    return map_batches(values, of, _FOUND)


def _best(values: DataFrame, ref: DataFrame, shard_names: int) -> DataFrame:
    """value, entry_id, distance of each value with a candidate. The list is searched shard by shard; a shard, of bounded
    size, is all that goes through the driver or is held by a task at a time."""
    names = ref.select("entry_id", "name", "is_acronym").where("name <> ''").distinct()
    shards = max(1, -(-names.count() // shard_names))
    parts = []
    for k in range(shards):
        mine = names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k) if shards > 1 else names
        rows = [tuple(r) for r in mine.orderBy("name", "entry_id").toLocalIterator()]
        if rows:
            parts.append(_search(values, values.sparkSession.sparkContext.broadcast(rows)))
    if not parts:
        return values.select("value", F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("int").alias("distance")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) == 1:
        return out.select("value", "entry_id", "distance")
    best = out.groupBy("value").agg(F.min(F.struct("stage", "distance", "reading", "name", "entry_id")).alias("b"))
    return best.select("value", "b.entry_id", "b.distance")


def map_values(df: DataFrame, fields: dict[str, DataFrame], id_col: str = "record_id", shard_names: int = SHARD_NAMES) -> DataFrame:
    """record_id, field_name, entry_id, distance of each record and each field (column name: reference list with
    entry_id, name, is_acronym) whose value is not null, blank or a stand-in; "UNMATCHED" and null distance if no
    entry is within reach.

    Each distinct value is looked up once, however many rows have it, and joined back to them. Candidates are ordered
    by stage (equal, near, near with exchanged letters, abbreviated), distance, reading, name, entry id. Repeated rows
    give repeated results; an empty reference list leaves everything unmatched."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.btrim(F.col(c), F.lit(" \t\r\n\u00a0")).alias("value")) for c in fields]))
    rows = df.select(F.col(id_col).cast("long").alias("record_id"), each.alias("x")).select("record_id", "x.*").where((F.col("value") != "") & ~F.lower("value").isin(*STAND_INS))
    found = None
    for field, ref in fields.items():
        values = rows.where(F.col("field_name") == field).select("value").distinct()
        parts = values.sparkSession.sparkContext.defaultParallelism
        one = _best(values.repartition(parts, "value"), ref, shard_names).withColumn("field_name", F.lit(field))
        found = one if found is None else found.unionByName(one)
    joined = rows.join(found, ["field_name", "value"], "left")
    return joined.select("record_id", "field_name", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id"), F.col("distance").cast("long").alias("distance"))


def reference(df: DataFrame, id_col: str, name_cols: list[str] = (), list_cols: list[str] = (), acronym_cols: list[str] = ()) -> DataFrame:
    """entry_id, name, is_acronym from a table of entries."""
    parts = [df.select(F.col(id_col).alias("entry_id"), F.col(c).alias("name"), F.lit(False).alias("is_acronym")) for c in name_cols]
    parts += [df.select(F.col(id_col).alias("entry_id"), F.explode(c).alias("name"), F.lit(False).alias("is_acronym")) for c in list_cols]
    parts += [df.select(F.col(id_col).alias("entry_id"), F.col(c).alias("name"), F.lit(True).alias("is_acronym")) for c in acronym_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name is not null")
