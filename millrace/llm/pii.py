"""Problem 10: personal information in free text, found and replaced by typed placeholders.

Addresses, numbers and e-mails have forms of their own and are found by patterns. Names are labelled by a skip-chain
conditional random field: the tokens of a stretch of capitalised words form a chain, equal and similar words of a
document are joined by skip edges whose potential favours one role for both, and messages are passed over chains and
skip edges until they change no more. The potentials of words are fitted on the whole corpus, from how often a word
stands beside a known name in the form of a name."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches
from millrace.runtime import ship, spread, stage

_S = "[ \\t\u00a0\u2007\u2009\u202f\u3000]"  # white space within a line
_AT = rf"(?:{_S}{{0,2}}[@＠]{_S}{{0,2}}|{_S}{{0,2}}[(\[{{]{_S}?at{_S}?[)\]}}]{_S}{{0,2}})"
_DOT = rf"(?:\.|{_S}{{0,2}}[(\[{{]{_S}?dot{_S}?[)\]}}]{_S}{{0,2}}|{_S}{{1,2}}dot{_S}{{1,2}})"
_SPELLED = rf"(?:{_S}{{0,2}}[(\[{{]{_S}?dot{_S}?[)\]}}]{_S}{{0,2}}|{_S}{{1,2}}dot{_S}{{1,2}})"
_LOCAL = rf"[A-Za-z0-9](?:[\w.+%'-]*[\w+-])?(?:{_SPELLED}[\w+-]+)*"
_HOST = r"[A-Za-z0-9-]+"
EMAIL = re.compile(rf"(?<![\w.+-])(?:{_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,}}|{_LOCAL}{_S}{{1,2}}at{_S}{{1,2}}{_HOST}(?:{_SPELLED}{_HOST})*{_SPELLED}[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_D = "[-. \u2010\u2011\u2013\u2014\u00a0\u2007\u2009\u202f]"
_EXT = rf"(?:,?{_S}{{1,2}}(?:ext\.?|extension|x){_S}?\d{{1,6}})?"
PHONE = re.compile(rf"(?<![\w.\-–/$#])(?:\+\d{{1,3}}{_D}{{0,2}}|1{_D}{{1,2}})?(?:\(\d{{3}}\){_D}{{0,2}}|\d{{3}}{_D}{{1,2}})\d{{3}}{_D}{{1,2}}\d{{4}}(?![\w]|[-–]\d){_EXT}|(?<![\w.\-–/$#])(?:\+?1)?[2-9]\d{{9}}(?!\w){_EXT}|(?<![\w.\-–/$#])\+\d{{1,3}}(?:{_D}{{1,2}}\(?\d{{1,4}}\)?){{2,5}}(?!\w)", re.A)
ID_NUMBER = re.compile(rf"(?<![\w.\-–/$#])(?:\d{{3}}([-. –]|  )\d{{2}}\1\d{{4}}|\d{{9}}|[A-Z]\d{{7,9}}|\d[A-Z]\d{{3}}[A-Z]\d{{2}}|[A-Z]{{2}}\d{{6,7}}|[A-Z]{{2,4}}-\d{{4}}-\d{{4}}-\d)(?![\w]|[-–]\d)", re.I | re.A)
#: Words before a number that say it is no person's.
_NOT_PERSONAL = re.compile(r"(?:\blots?|\binvoice|\bgrant|\bform|\bresolution|\broom|\bitem|\border|\bversion|\bmodel|\bcase law|\bbill|\bpermit|\bpart|\bserial|\bsku|\btotal was|\blote|\bfactura|\bformulario|\brésolution|\bfacture|\$)[ \t :#n°º.]{0,4}(?:no\.?|number|numéro)?\s?$", re.I)
#: A word of a street's name: letters with hyphens and apostrophes, an abbreviation with its point, or an ordinal. Of
#: three words and more each has a capital or is a small word, or else sentences would be taken for streets.
_STREET_WORD = r"(?:(?:st|ste|mt|ft|dr|jr|sr|[a-z])\.|[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d{1,3}(?:st|nd|rd|th)\b)"
_CAPITAL_WORD = rf"(?:(?=(?-i:[A-ZÀ-ÖØ-Þ\d])){_STREET_WORD}|(?:of|the|and|de|la|del|las|los|y)\b)"
_TYPE = r"(?:street|avenue|boulevard|terrace|parkway|highway|circle|square|drive|court|place|trail|lane|road|pkwy|blvd|way|ave|ter|cir|hwy|st|rd|dr|ln|ct|pl)"
ADDRESS = re.compile(
    rf"\d{{1,5}}(?:-?[a-z])?{_S}{{1,2}}(?:(?:north|south|east|west|[nsew])\.?{_S}{{1,2}})?(?:(?:{_STREET_WORD}{_S}{{1,2}}){{1,2}}?|(?:{_CAPITAL_WORD}{_S}{{1,2}}){{3,5}}?){_TYPE}\b\.?"
    rf"(?:,?{_S}{{1,2}}(?:apt|unit|space|suite|ste)\.?{_S}{{0,2}}\#?\d+[a-z]?|,?{_S}{{1,2}}\#\d+[a-z]?)?",
    re.I,
)
STREET_FIRST = re.compile(
    rf"(?<!\w)(?:calle|camino|avenida|av\.|paseo|carretera|calzada|rue|chemin|impasse|allée){_S}{{1,2}}(?:(?:de|del|la|las|los|du|des){_S}{{1,2}}){{0,2}}[^\W\d_]+(?:{_S}{{1,2}}[^\W\d_]+)?,?{_S}{{1,2}}(?:\#|n\.?º{_S}?|n°{_S}?|núm\.?{_S}?|no\.?{_S}?)?\d{{1,5}}(?:,{_S}{{1,2}}(?:piso|apto\.?){_S}{{1,2}}\d+)?"
    rf"|(?<!\w)\d{{1,5}}(?:{_S}?(?:bis|ter))?,?{_S}{{1,2}}(?:rue|avenue|boulevard|chemin|allée|impasse){_S}{{1,2}}[^\W\d_]+",
    re.I,
)
_STREETS = ("calle", "camino", "avenida", "av. ", "paseo", "carretera", "calzada", "rue", "chemin", "impasse", "allée", "boulevard", "avenue")
#: What a match of the patterns above can't do without; cheap to find.
_PHONE_CORE = re.compile(rf"\d{{3}}{_D}{{0,2}}\d{{4}}|\+\d")
_ID_CORE = re.compile(r"\d{7}|\d\d.{1,2}\d{4}|\d[A-Za-z]\d{3}|[A-Za-z]\d{6}|\d{4}-\d{4}-\d")
_EMAIL_CORE = re.compile(rf"[@＠]|[(\[{{]{_S}?at{_S}?[)\]}}]|{_S}at{_S}{{1,2}}{_HOST}(?:{_SPELLED}{_HOST})*{_SPELLED}[A-Za-z]{{2}}", re.I)


def _around(core: re.Pattern, pattern: re.Pattern, text: str, reach: int):
    """The matches of pattern that hold one of its core; reach: more than the length of any match, so none is lost."""
    low = high = -1
    for m in core.finditer(text):
        if m.start() - reach <= high:
            high = m.end() + reach
            continue
        if high > 0:
            yield from pattern.finditer(text, low, high)
        low, high = max(0, m.start() - reach), m.end() + reach
    if high > 0:
        yield from pattern.finditer(text, low, high)


def _on_lines(core: re.Pattern, pattern: re.Pattern, text: str):
    """The matches of pattern, which has no longest one, in the lines that hold its core; none spans lines."""
    done = 0
    for m in core.finditer(text):
        if m.start() >= done:
            low = text.rfind("\n", 0, m.start()) + 1
            done = (text.find("\n", m.end()) + 1 or len(text) + 1) - 1
            yield from pattern.finditer(text, low, done)


#: Before a number of its own stands none of these.
_JOINED = re.compile(r"[\w.\-–/$#]")
_MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}

_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’](?=[A-ZÀ-ÖØ-Þ]))*")
#: What may stand between two words of one name: white space, a hyphen, a comma, a point after an initial.
_GAPS = {x: " " for x in (" ", "  ", "\u00a0", "\u00a0\u00a0", "\n", " \n")} | {"-": "-"} | {c + x: c for c in ",." for x in (" ", "  ", "\u00a0", "\n")}
OTHER, GIVEN, INITIAL, FAMILY, FAMILY_1, GIVEN_2, INITIAL_2 = range(7)
#: Labels that may follow one another over each kind of gap, with the weight of the pair.
_STEPS = {
    " ": {(GIVEN, FAMILY): 1.5, (GIVEN, INITIAL): 1.5, (GIVEN_2, INITIAL_2): 1.0},
    "-": {(FAMILY, FAMILY): 2.0, (FAMILY_1, FAMILY_1): 2.0, (GIVEN, GIVEN): 0.5},
    ",": {(FAMILY_1, GIVEN_2): 2.0},
    ".": {(INITIAL, FAMILY): 1.5, (INITIAL, INITIAL): 0.5},
}
#: After these labels a name may begin or other words follow, over any gap but a hyphen.
_ENDS = (OTHER, FAMILY, GIVEN_2, INITIAL_2)
_BEGINS = (OTHER, GIVEN, INITIAL, FAMILY_1)
_KNOWN, _UNKNOWN, _SKIP = 4.0, -6.0, 1.5
#: Words less often beside a known partner than at these log odds (one place in thirteen) are ordinary words.
_LEAST_ODDS = -2.5
#: Messages are passed until none changes by more, or so many rounds (trees need two; loops settle within a few).
_SETTLED, _ROUNDS = 1e-3, 50


def _tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, word in lower case, gap to the token before) of each capitalised word; the gap is "" if they can't
    be of one name."""
    out, last = [], -9
    for m in _CAP.finditer(text):
        s = m.start()
        gap = _GAPS.get(text[last:s], "") if 0 < s - last <= 3 else ""
        if gap == "." and len(out[-1][2]) > 1:
            gap = ""
        out.append((s, m.end(), m[0].lower(), gap))
        last = m.end()
    return out


def _pairs(text: str, count: Counter) -> None:
    """Counts how often words stand as (given, family) and as a word at all."""
    found = _tokens(text)
    for w in found:
        if len(w[2]) > 1:
            count["", w[2]] += 1
    n = len(found)
    for i in range(n - 1):
        a, b = found[i], found[i + 1]
        gap = b[3]
        k = i + 1
        if gap == " " and len(b[2]) == 1 and i + 2 < n and found[i + 2][3] == ".":
            k, b = i + 2, found[i + 2]
        if len(a[2]) < 2 or len(b[2]) < 2:
            continue
        after = found[k + 1][3] if k + 1 < n else ""
        if gap == " " and after != ",":
            count[a[2], b[2]] += 1
        elif gap == "," and k == i + 1 and after != " ":
            count[b[2], a[2]] += 1


def learn_names(docs: DataFrame, known: DataFrame, text_col: str = "text", rounds: int = 3) -> DataFrame:
    """word, given, family: the potentials of words as a given and as a family name, for the words that are known or
    that the corpus shows to be one.

    Pairs of words in the form of a name are counted in each task, then over all documents. A word's odds are those of
    standing beside a known partner; what comes out as a name counts as a partner in the next round."""
    spark = docs.sparkSession
    ship(spark)

    def count(batches):
        total: Counter = Counter()

        def rows():
            a, b = zip(*total) if total else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(total.values(), pa.int64())], ["g", "f", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    _pairs(t, total)
            if len(total) > 300_000:
                yield rows()
                total.clear()
        yield rows()

    counts = stage(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "g string, f string, n long").groupBy("g", "f").agg(F.sum("n").alias("n")), "pairs")
    pairs, alone = counts.where("g <> ''"), counts.where("g = ''").select(F.col("f").alias("word"), F.col("n").alias("total"))
    seeds = known.where("name_text is not null").select(F.lower("name_text").alias("word"), (F.lower("name_kind") == "given").alias("is_given")).distinct()
    given, family = seeds.where("is_given").select("word"), seeds.where("not is_given").select("word")
    table = None
    for k in range(rounds):
        as_given = pairs.join(family.withColumnRenamed("word", "f"), "f", "left_semi").groupBy(F.col("g").alias("word")).agg(F.sum("n").alias("n_given"))
        as_family = pairs.join(given.withColumnRenamed("word", "g"), "g", "left_semi").groupBy(F.col("f").alias("word")).agg(F.sum("n").alias("n_family"))
        odds = lambda n, t: F.log((n + 0.5) / (F.greatest(t - n, F.lit(0)) + 1.5))
        joined = alone.join(as_given, "word", "left").join(as_family, "word", "left").fillna(0, ["n_given", "n_family"]).where("n_given + n_family > 0")
        table = stage(joined.select("word", odds(F.col("n_given"), F.col("total")).alias("given"), odds(F.col("n_family"), F.col("total")).alias("family")), f"names{k}")
        given = table.where("given > -0.7 and given > family").select("word").union(seeds.where("is_given").select("word")).distinct()
        family = table.where("family > -0.7 and family > given").select("word").union(seeds.where("not is_given").select("word")).distinct()
    sure = seeds.groupBy("word").agg(F.max(F.when(F.col("is_given"), _KNOWN)).alias("g"), F.max(F.when(~F.col("is_given"), _KNOWN)).alias("f"))
    return table.where(f"given > {_LEAST_ODDS} or family > {_LEAST_ODDS}").join(sure, "word", "full").select(
        "word", F.greatest(F.coalesce("given", F.lit(_UNKNOWN)), F.coalesce("g", F.lit(_UNKNOWN))).alias("given"), F.greatest(F.coalesce("family", F.lit(_UNKNOWN)), F.coalesce("f", F.lit(_UNKNOWN))).alias("family")
    )


class NameModel:
    """The skip-chain model over the potentials of words (word: given, family). skip: the weight of a skip edge."""

    def __init__(self, table: dict[str, tuple[float, float]], skip: float = _SKIP) -> None:
        self.table, self.skip = table, skip

    def names(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each name."""
        table = self.table
        found = _tokens(text)
        hits = [i for i, t in enumerate(found) if t[2] in table]
        if not hits:
            return []
        chains: list[list[int]] = []
        done = -1
        for i in hits:  # a chain is the whole stretch around a word with potentials
            if i <= done:
                continue
            a = b = i
            while found[a][3]:
                a -= 1
            while b + 1 < len(found) and found[b + 1][3]:
                b += 1
            chains.append(list(range(a, b + 1)))
            done = b
        unary = {i: self._unary(found[i]) for c in chains for i in c}
        best = [self._best(found, c, unary, {}) for c in chains]
        edges = _skip_edges(found, unary) if self.skip else []
        if edges:
            # where the best labels of the chains keep all edges, no labels are better for all together
            role = {i: _ROLE[label] for c, labels in zip(chains, best) for i, label in zip(c, labels)}
            if any(role[i] != role[j] for i, j in edges):
                extra = self._messages(found, chains, unary, edges)
                best = [self._best(found, c, unary, extra) for c in chains]
        out = []
        for chain, labels in zip(chains, best):
            start = None
            for k, (i, label) in enumerate(zip(chain, labels)):
                before = labels[k - 1] if k else OTHER
                begins = label != OTHER and (before == OTHER or (before, label) not in _STEPS.get(found[i][3], {}))
                if begins:
                    if start is not None:
                        out.append((start, found[chain[k - 1]][1]))
                    start = found[i][0]
                elif label == OTHER and start is not None:
                    out.append((start, found[chain[k - 1]][1]))
                    start = None
            if start is not None:
                out.append((start, found[chain[-1]][1]))
        return out

    def _messages(self, found, chains, unary, edges) -> dict[int, dict[int, float]]:
        """What the skip edges add to each token's potentials in the end.

        Each occurrence of a word is joined to the one before it, and a similar word (an accent or one letter more) to
        its last one. An edge's potential is exp(skip) where both tokens have the same role (none, given, family). Its
        message is the sender's belief without what came over the same edge, taken through that potential; beliefs of
        a chain are exact, by its forward and backward sums."""
        of = {i: c for c, chain in enumerate(chains) for i in chain}
        into: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, j in edges:
            into[j].append((i, j))
            into[i].append((j, i))
        message = {e: (0.0, 0.0, 0.0) for i in into for e in into[i]}
        extra: dict[int, dict[int, float]] = {}
        gain, stale = math.exp(self.skip) - 1.0, {of[i] for i in into}
        for _ in range(_ROUNDS):
            belief: dict[int, dict[int, float]] = {}
            for c in stale:
                belief.update(self._marginals(found, chains[c], unary, extra))
            stale = set()
            for i in belief:
                for j, _i in into.get(i, ()):
                    back = message[j, i]
                    role = [1e-9, 1e-9, 1e-9]
                    for label, x in belief[i].items():
                        role[_ROLE[label]] += x * math.exp(-back[_ROLE[label]])
                    total = sum(role)
                    new = tuple(math.log(1.0 + gain * x / total) for x in role)
                    if max(abs(a - b) for a, b in zip(new, message[i, j])) > _SETTLED:
                        message[i, j] = new
                        stale.add(of[j])
            for i, own in into.items():
                if of[i] in stale:
                    total = [sum(message[e][r] for e in own) for r in range(3)]
                    extra[i] = {label: total[_ROLE[label]] for label in unary[i]}
            if not stale:
                break
        return extra

    def _unary(self, token: tuple[int, int, str, str]) -> dict[int, float]:
        w = token[2]
        if len(w) == 1:
            return {OTHER: 0.0, INITIAL: -0.5, INITIAL_2: -0.5}
        given, family = self.table.get(w, (_UNKNOWN, _UNKNOWN))
        out = {OTHER: 0.0}
        if given > _UNKNOWN or family > -1:
            out |= {GIVEN: given, GIVEN_2: given}
        if family > _UNKNOWN or given > -1:
            out |= {FAMILY: family, FAMILY_1: family}
        if len(out) == 1:
            out |= {GIVEN: _UNKNOWN, GIVEN_2: _UNKNOWN, FAMILY: _UNKNOWN, FAMILY_1: _UNKNOWN}
        return out

    @staticmethod
    def _step(gap: str, a: int, b: int) -> float | None:
        x = _STEPS.get(gap, {}).get((a, b))
        if x is not None:
            return x
        if gap != "-" and a in _ENDS and b in _BEGINS:
            return 0.0
        return 0.0 if gap == "-" and a == b == OTHER else None

    def _scores(self, found, chain, unary, extra) -> list[dict[int, float]]:
        return [{label: x + extra.get(i, {}).get(label, 0.0) for label, x in unary[i].items()} for i in chain]

    def _best(self, found, chain, unary, extra) -> list[int]:
        score = self._scores(found, chain, unary, extra)
        alpha = [{label: x for label, x in score[0].items() if label in _BEGINS}]
        back: list[dict[int, int]] = [{}]
        for k in range(1, len(chain)):
            gap, now, ptr = found[chain[k]][3], {}, {}
            for b, x in score[k].items():
                best = None
                for a, y in alpha[-1].items():
                    if (s := self._step(gap, a, b)) is not None and (best is None or y + s > best):
                        best, ptr[b] = y + s, a
                if best is not None:
                    now[b] = best + x
            alpha.append(now)
            back.append(ptr)
        last = max((label for label in alpha[-1] if label in _ENDS), key=lambda v: alpha[-1][v])
        labels = [last]
        for k in range(len(chain) - 1, 0, -1):
            labels.append(back[k][labels[-1]])
        return labels[::-1]

    def _marginals(self, found, chain, unary, extra) -> dict[int, dict[int, float]]:
        score = self._scores(found, chain, unary, extra)
        n = len(chain)
        fwd = [{label: math.exp(x) for label, x in score[0].items() if label in _BEGINS}]
        for k in range(1, n):
            gap = found[chain[k]][3]
            fwd.append({b: math.exp(x) * sum(y * math.exp(s) for a, y in fwd[-1].items() if (s := self._step(gap, a, b)) is not None) for b, x in score[k].items()})
        bwd = [{label: 1.0 for label in score[-1] if label in _ENDS}]
        for k in range(n - 1, 0, -1):
            gap = found[chain[k]][3]
            bwd.append({a: sum(y * math.exp(score[k][b]) * math.exp(s) for b, y in bwd[-1].items() if (s := self._step(gap, a, b)) is not None) for a in score[k - 1]})
        bwd.reverse()
        out = {}
        for k, i in enumerate(chain):
            own = {label: x * bwd[k].get(label, 0.0) for label, x in fwd[k].items()}
            z = sum(own.values()) or 1.0
            out[i] = {label: x / z for label, x in own.items()}
        return out


_ROLE = {OTHER: 0, GIVEN: 1, GIVEN_2: 1, FAMILY: 2, FAMILY_1: 2, INITIAL: 1, INITIAL_2: 1}


def _plain(word: str) -> str:
    """Without accents and apostrophes."""
    t = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return t.replace("'", "").replace("’", "")


def _skip_edges(found, unary) -> list[tuple[int, int]]:
    """Pairs of tokens of chains, each joined to the last token before it of the same word, and words that differ by
    accents, apostrophes or one letter at the end to the last token of the other."""
    last: dict[str, int] = {}
    edges = []
    for i in sorted(unary):
        w = found[i][2]
        if len(w) < 2:
            continue
        if w in last:
            edges.append((last[w], i))
        else:
            p = _plain(w)
            near = [last[v] for v in dict.fromkeys((p, p[:-1])) if len(v) > 3 and v in last]
            if near:
                edges.append((max(near), i))
            last.setdefault(p, i)
        last[w] = i
    return edges


def find_pii(text: str, model: NameModel) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each piece of personal information, in order, without overlaps."""
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or e <= a for s, e, _ in taken)

    low = text.lower()
    if "@" in text or "＠" in text or "at]" in low or "at)" in low or "at}" in low or (" dot" in low and " at " in low) or " dot" in low:
        for m in _on_lines(_EMAIL_CORE, EMAIL, text):
            taken.append((m.start(), m.end(), "email"))
    if any(map(str.isdigit, text)):
        matches = [("phone", m) for m in _around(_PHONE_CORE, PHONE, text, 64)]
        matches += [("id_number", m) for m in _around(_ID_CORE, ID_NUMBER, text, 32)]
        matches += [("address", m) for m in ADDRESS.finditer(text) if not m.start() or not _JOINED.match(text[m.start() - 1])]
        if any(w in low for w in _STREETS):
            matches += [("address", m) for m in STREET_FIRST.finditer(text)]
        for kind, m in matches:
            a, b = m.span()
            if free(a, b) and not (kind != "address" and _NOT_PERSONAL.search(text[max(0, a - 24) : a])) and not (kind == "address" and _no_address(m[0])):
                taken.append((a, b, kind))
    for a, b in model.names(text):
        if free(a, b):
            taken.append((a, b, "name"))
    return [(k, s, e) for s, e, k in sorted(taken)]


def _no_address(found: str) -> bool:
    parts = found.lower().split()
    return len(parts) > 2 and parts[1].strip(".") in _MONTHS


_MODEL: dict = {}


def _model(table: dict) -> NameModel:
    if _MODEL.get("table") is not table:
        _MODEL["table"], _MODEL["model"] = table, NameModel(table)
    return _MODEL["model"]


#: Words with potentials are broadcast (some 60 bytes each); with more of them than this, each document gets its own.
BROADCAST_WORDS = 1_000_000


def _with_model(docs: DataFrame, known: DataFrame, fn, schema: str, id_col: str, text_col: str, broadcast_words: int) -> DataFrame:
    """docs through fn(ids, texts, models)."""
    own = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    words = stage(learn_names(own, known), "words")
    if words.count() <= broadcast_words:
        kept = own.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in words.toLocalIterator()})

        def of(b: pa.RecordBatch):
            model = _model(kept.value)
            texts = b.column(1).to_pylist()
            yield fn(b.column(0).to_pylist(), texts, [model] * len(texts))

        return map_batches(own, of, schema)
    tagged = own.withColumn("row", F.xxhash64("doc_id", "text"))

    def tokens(b: pa.RecordBatch):
        found = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for w in {x[2] for x in _tokens(t)}]
        rows, own_words = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(own_words, pa.string())], ["row", "word"])

    pairs = map_batches(tagged.select("row", "text"), tokens, "row long, word string").distinct().join(words, "word")
    per_row = pairs.groupBy("row").agg(F.collect_list(F.struct("word", "given", "family")).alias("words"))

    def each(b: pa.RecordBatch):
        models = [NameModel({x["word"]: (x["given"], x["family"]) for x in ws or ()}) for ws in b.column(2).to_pylist()]
        yield fn(b.column(0).to_pylist(), b.column(1).to_pylist(), models)

    return map_batches(tagged.join(per_row, "row", "left").select("doc_id", "text", "words"), each, schema)


def personal_information(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, kind, char_pos (from 1), found: each piece of personal information. Null and empty texts have none;
    repeated rows give repeated results; known (name_text, name_kind) may be empty."""

    def of(ids, texts, models):
        rows = [(i, k, s + 1, t[s:e]) for i, t, m in zip(ids, texts, models) if t for k, s, e in find_pii(t, m)]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()))], ["doc_id", "kind", "char_pos", "found"])

    return _with_model(docs, known, of, "doc_id long, kind string, char_pos long, found string", id_col, text_col, broadcast_words)


def redact(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, text with <PHONE>, <EMAIL>, <ID_NUMBER>, <ADDRESS>, <NAME> in place of what was found; the rest of the
    text, null and empty texts stay as they are."""

    def clean(t: str, model: NameModel) -> str:
        out, last = [], 0
        for k, s, e in find_pii(t, model):
            out += [t[last:s], f"<{k.upper()}>"]
            last = e
        return "".join(out) + t[last:]

    def of(ids, texts, models):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([clean(t, m) if t else t for t, m in zip(texts, models)], pa.string())], ["doc_id", "text"])

    return _with_model(docs, known, of, "doc_id long, text string", id_col, text_col, broadcast_words)
