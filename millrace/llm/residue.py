"""Problem 6: unfilled slots, filler text, and error messages or demands for scripts in place of content.

Two ways, as a page is met: unresolved slots and filler are looked for in every text; for the rest, message templates
are mined from the lines of all pages with a prefix tree of fixed depth (number of tokens, then the first tokens), each
template gets a verdict once, and the verdicts go back to the pages that hold its messages."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD
from millrace.llm.mainbody import _BODY, clean, kind_of, sentences, text_verdicts, visible_lines
from millrace.runtime import ship, spread, stage, unique_by

_NAME = r"[A-Za-z][\w.:/ -]{0,40}?"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|[$#]?\{{\s*{_NAME}\s*\}}|%[A-Za-z][A-Za-z_.]{{2,40}}%|@@[A-Za-z][\w.]{{1,40}}@@|\[\[\s*{_NAME}\s*\]\]|(?<!_)__[A-Za-z][A-Za-z_.]{{1,40}}?__(?!_)"
    rf"|<%=?\s*{_NAME}\s*%>|[<\[](?:insert|your|enter|add|type)\s+[^<>\[\]\n]{{2,40}}[>\]]|<<\s*{_NAME}\s*>>|\[object Object\]|\bundefined undefined\b|\bXX/XX/(?:20)?XX(?:XX)?\b|\{{%.{{1,60}}?%\}}",
    re.I,
)
_LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split())
FILLER = re.compile(r"\[placeholder\b|^(?:sample|placeholder|dummy) (?:copy|text|paragraph)\b|\byour text (?:goes )?here\b|replace this sample|^(?:x{3,}\W+){2,}|^texto de relleno|^texte de remplissage|test page please ignore|\bblah blah\b|\basdf|\btexto de prueba\b", re.I)

#: What a message of this kind says; looked for in templates only.
MESSAGE = re.compile(
    r"^loading\b ?(?:\.\.\.|…)?$|^please wait\b|^cargando|(?:enable|turn on|activate|allow|active|activez|habilite) (?:javascript|scripts?|cookies)|requires? (?:javascript|scripts)|(?:javascript|scripts?) (?:is|are) (?:disabled|off|required|needed)|has them switched off|needs? javascript"
    r"|^traceback \(|^fatal (?:error|exception)|exception\b.*\b(?:java|null|at)\b|^(?:uncaught )?[a-z.]*(?:error|exception): |^at [\w.$]+\(|^file (?:\"|<\*>)|^warning: |failed to open|on line (?:\d+|<\*>)$|^(?:parse|syntax|runtime) error|\bstack trace\b|^mysql|^sqlstate|^ora-"
    r"|^(?:oops|sorry|we're sorry|we are sorry)\b|something went wrong|^(?:service|page|site|content|file|this page|the page|the site) (?:is )?(?:temporarily )?(?:unavailable|not found|not available|missing|expired)|down for maintenance|gone away|error establishing|internal (?:server )?(?:error|problem)|^error\b|^\(?(?:<\*>|\d{3})\)? ?[-:]? ?(?:forbidden|not found|error|unauthori[sz]ed|internal|bad|service)"
    r"|(?:gateway|connection|request) (?:timeout|timed out|refused|reset)|contacting upstream|not found (?:in|on) (?:the|this) (?:theme|server)|no encontrad|no existe|introuvable|n'existe pas|^se produjo un error|^une erreur s'est produite|^template <?.*not found|browser (?:is )?(?:not|un)supported|browser is not supported|找不到|不存在|无法访问|启用"
    r"|is gone\b|does not exist on this|moved or removed|may have (?:been )?moved|link is broken|^nothing lives at|too many requests|slow down and retry|session has expired|log in again|content is restricted|sign in with .* to (?:read|view|continue)|^(?:access|permission) (?:is )?(?:denied|forbidden)|access to this (?:site|page) (?:was|is|has been) (?:blocked|denied)|blocked by the firewall|do not have permission|not authori[sz]ed to|you are not a robot|verify (?:that )?you are (?:a )?human|checking your browser|return to the start page|acceso (?:denegado|prohibido)|accès (?:refusé|interdit)"
)
#: What says so only beside a slot that mining or masking has found: one thing of a kind is missing or can't be shown.
SLOTTED = re.compile(
    r"<\*>.*\b(?:could not|couldn't|can not|cannot|can't) be (?:loaded|found|opened|displayed|reached|shown|rendered|processed)\b|<\*> (?:was |were |is )?not (?:found|installed|registered|loaded)\b|\b(?:failed|unable) to (?:load|find|open|render|reach|connect|parse)\b.*<\*>"
    r"|<\*>.*\b(?:failed to (?:load|render|connect)|no longer exists?|does not exist|has been (?:removed|suspended))\b|^(?:undefined|unknown|missing|invalid) (?:variable|index|function|property|template|module|widget|parameter)\b.*<\*>"
)
#: Furniture that can't be mistaken for a message.
_PLAIN = {"menu", "bar", "crumb", "head", "link", "legal", "meta", "blank"}
#: Masked lines of so many characters or more are judged sentence by sentence.
MESSAGE_CHARS = 200
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_DIGIT = re.compile(r"\d")
_CALL = re.compile(r"[a-z$_][\w.$]*(?=\()")
#: Words of the patterns above; where two messages differ in one of them no slot is made of it.
_TELLING = set(WORD.findall(re.sub(r"\\[a-zA-Z]", " ", MESSAGE.pattern + " " + SLOTTED.pattern)))
_UNSPACED = [w for w in _TELLING if not w.isascii() and any(ord(c) > 0x2FFF for c in w)]


def mask(line: str) -> str:
    """A line with its variable parts (quotations, paths, whatever holds a digit) as <*>."""
    return _masked(clean(line))


def _masked(t: str) -> str:
    if "'" in t or '"' in t:
        t = _QUOTED.sub("<*>", t)
    return " ".join([x if x.isalpha() else _slot(x) for x in t.split(" ")])


def _slot(token: str) -> str:
    """<*> for a token with a digit or of a path; of a call, as in frames of a stack trace, the name stays."""
    if not _DIGIT.search(token) and token.count("/") < 2:
        return token
    call = _CALL.match(token)
    return f"{call[0]}(<*>)" if call else "<*>"


def parts(line: str) -> list[str]:
    """What is judged of a line, masked: the line, or its sentences if it is a long one."""
    t = clean(line)
    if len(t) < MESSAGE_CHARS:
        return [_masked(t)]
    own = [_masked(x) for x in sentences(t)]
    return own if sum(map(len, own)) + len(own) > MESSAGE_CHARS else [_masked(t)]


_SLOT_HINTS = ("{", "@@", "[[", "[i", "[y", "[e", "[a", "[t", "[o", "<", "undefined", "xx/", "__")
_FILLER_HINTS = ("placeholder", "sample ", "your text", "relleno", "remplissage", "test page", "blah", "asdf", "dummy", "de prueba", "xxx")
_LATIN_HINTS = ("ipsum", "lorem", "consectetur", "adipiscing", "eiusmod", "incididunt", "nostrud", "aliqua", "veniam", "minim ", "elit ")


def has_residue(lines: list[str], text: str, low: str) -> bool:
    """Whether the text (low: in lower case) holds an unfilled slot or filler."""
    if (any(w in low for w in _SLOT_HINTS) or low.count("%") > 1) and SLOT.search(text):
        return True
    if any(w in low for w in _FILLER_HINTS) and any(FILLER.search(x.strip()) for x in lines):
        return True
    if any(w in low for w in _LATIN_HINTS):
        for x in lines:
            found = re.findall(r"[a-z]+", x.lower())
            if len(found) >= 4 and sum(w in _LATIN for w in found) >= 0.8 * len(found):
                return True
    return False


class PrefixTree:
    """Templates of messages: a tree of fixed depth leads by the number of tokens, the first ones, and the places of
    telling words to a leaf, whose clusters take a message if enough of its tokens agree; those that differ become <*>.
    Telling words never do, so the verdict of a template misses nothing that one of its messages says."""

    def __init__(self, depth: int = 3, alike: float = 0.4) -> None:
        self.depth, self.alike = depth, alike
        self.leaves: dict[tuple, list[list]] = {}
        self._known: dict[str, bool] = {}

    def telling(self, token: str) -> bool:
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[token] = any(w in _TELLING for w in WORD.findall(token)) or any(w in token for w in _UNSPACED)
        return found

    def key(self, tokens: list[str]) -> tuple:
        return (len(tokens), *tokens[: self.depth - 1], *[(i, t) for i, t in enumerate(tokens) if self.telling(t)])

    def add(self, message: str, key: tuple | None = None) -> list:
        """The cluster [template's tokens, number of messages] that the message belongs to now."""
        tokens = message.split(" ")
        leaf = self.leaves.setdefault(self.key(tokens) if key is None else key, [])
        best, same = None, self.alike * len(tokens) - 1e-9
        for c in leaf:
            n = sum(map(str.__eq__, c[0], tokens))
            if n > same:
                best, same = c, n
        if best is None:
            best = [tokens, 0]
            leaf.append(best)
        elif same < len(tokens):
            best[0] = [a if a == b else "<*>" for a, b in zip(best[0], tokens)]
        best[1] += 1
        return best


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that are in no group."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\\.|[()|]", pattern):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "|" and not depth:
            out.append(pattern[start : m.start()])
            start = m.end()
    return [*out, pattern[start:]]


#: MESSAGE in two parts, those alternatives that begin a line and the others.
_BEGINS, _HOLDS = (re.compile("|".join(x for x in _alternatives(MESSAGE.pattern) if x.startswith("^") == first)) for first in (True, False))


def is_message(template: str) -> bool:
    """The verdict on a template: what MESSAGE finds, or SLOTTED beside a slot."""
    return bool(_BEGINS.match(template) or _HOLDS.search(template) or ("<*>" in template and SLOTTED.search(template)))


def _name(message: str) -> int:
    return xxhash.xxh3_64_intdigest(message) >> 1


_LINES: dict[str, tuple] = {}


def _judged(line: str, k: str) -> tuple:
    """Of a line: whether it is such as bodies consist of, whether it is a real one of these (no title), and names and
    texts of its masked parts; nothing for plain furniture. k: the kind of the line."""
    out = _LINES.get(line)
    if out is None:
        own = () if k in _PLAIN else tuple((_name(m), m) for m in parts(line))
        out = (2 * (k in _BODY and k != "title") + (k in _BODY), own)
        if len(line) <= 100:
            if len(_LINES) > 200_000:
                _LINES.clear()
            _LINES[line] = out
    return out


def _reader(weights: np.ndarray | None):
    """Of each page: whether it holds residue; the names of its masked lines (long ones by sentences), each with a code
    (8 x line + 4: first part + 2: real + 1: of the body); the masked lines that the task has not met before; and, with
    weights of problem 4, the numbers of the lines that are not main."""

    def run(batches):
        met: set[int] = set()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                lines, low = visible_lines(t), t.lower()
                bad = has_residue(lines, t, low)
                names, codes, new = [], [], []
                kinds = list(map(kind_of, lines)) if not bad else []
                for no, k in enumerate(kinds):
                    if k in _PLAIN:
                        continue
                    code, own = _judged(lines[no], k)
                    for j, (name, m) in enumerate(own):
                        names.append(name)
                        codes.append(8 * no + 4 * (j == 0) + code)
                        if name not in met:
                            met.add(name)
                            new.append(m)
                if len(met) > 2_000_000:
                    met.clear()
                furniture = None if weights is None or bad else [no for no, main in text_verdicts(t, weights, lines, kinds) if not main]
                for col, v in zip(cols, (i, bad, names, codes, new, furniture)):
                    col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "residue", "names", "codes", "new", "furniture"])

    return run


_READ = "id long, residue boolean, names array<long>, codes array<int>, new array<string>, furniture array<int>"


def read_pages(df: DataFrame, id_col: str = "page_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The staged table of _reader: each text is read once. Rows repeated with one id count once."""
    own = spread(unique_by(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null"), "id"), "id")
    ship(own.sparkSession)
    return stage(own.mapInArrow(_reader(weights), _READ), "lines")


_KEYS = PrefixTree()


def _leaf_of(b: pa.RecordBatch) -> pa.RecordBatch:
    messages = b.column(0).to_pylist()
    leaf = [_name(repr(_KEYS.key(m.split(" ")))) for m in messages]
    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), b.column(0)], ["leaf", "message"])


def _mine(batches):
    """The leaves of a task one after the other (rows come sorted): the cluster of each message as it is met; and at
    the end of a leaf a row for each cluster, with its template and verdict. Only one leaf's clusters are kept."""
    tree, now, ids = PrefixTree(), None, {}

    def flush(out):
        for c in tree.leaves.get(now, ()):
            t = " ".join(c[0])
            out.append((None, ids[id(c)], t, is_message(t), c[1]))
        tree.leaves.clear()
        ids.clear()

    def rows(out):
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["name", "cluster", "template", "bad", "n"])

    for b in batches:
        out: list[tuple] = []
        for leaf, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if leaf != now:
                flush(out)
                now = leaf
            c = tree.add(m, leaf)
            if c[1] == 1:
                ids[id(c)] = _name(f"{leaf} {m}")
            out.append((_name(m), ids[id(c)], None, None, None))
        yield rows(out)
    out = []
    flush(out)
    yield rows(out)


def mine_templates(messages: DataFrame) -> DataFrame:
    """name, cluster, template, bad, n of the masked lines in messages (column message, each once): a row for each
    message with its cluster, and a row without name for each cluster with its template, verdict and number of
    messages. Leaves are spread by all of their key, telling words included; a leaf streams through its task in
    alphabetical order."""
    ship(messages.sparkSession)
    keyed = messages.mapInArrow(lambda batches: map(_leaf_of, batches), "leaf long, message string")
    return stage(keyed.repartition("leaf").sortWithinPartitions("leaf", "message").mapInArrow(_mine, "name long, cluster long, template string, bad boolean, n long"), "templates")


def _bad_names(mined: DataFrame) -> DataFrame:
    """The names of the messages whose template is one of problem 6."""
    return mined.where("name is not null").select("name", "cluster").join(mined.where("bad").select("cluster"), "cluster", "left_semi").select("name")


def residue_cases(read: DataFrame) -> DataFrame:
    """id, reason of the cases among the pages of read_pages."""
    mined = mine_templates(read.select(F.explode("new").alias("message")).distinct())
    each = F.explode(F.arrays_zip("names", "codes")).alias("x")
    touched = read.select("id", each).select("id", F.col("x.names").alias("name")).join(_bad_names(mined), "name").groupBy("id").agg(F.collect_set("name").alias("bad"))
    lines = read.join(touched, "id").select("id", "bad", each).select("id", F.shiftright("x.codes", 3).alias("line"), F.col("x.codes").alias("code"), F.array_contains("bad", F.col("x.names")).alias("bad"))
    bit = lambda k: F.col("code").bitwiseAND(k) > 0
    n, n_bad = F.count("*"), F.count_if("bad")
    says = (n_bad * 2 >= n) | ((n_bad * 3 >= n) & (F.count_if(bit(4) & F.col("bad")) > 0))
    by_line = lines.groupBy("id", "line").agg(says.alias("bad"), F.max(bit(2)).alias("real"), F.max(bit(1)).alias("body"))
    pages = by_line.groupBy("id").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad") & F.col("real")).alias("n_real"), F.count_if(~F.col("bad") & F.col("body")).alias("n_rest"))
    messages = pages.where("n_bad > 0 and n_real = 0 and n_rest <= n_bad").select("id", F.lit("message").alias("reason"))
    return read.where("residue").select("id", F.lit("residue").alias("reason")).unionByName(messages)


def residue_pages(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, reason (slot or filler: "residue"; "message") of the pages that hold no real content or hold residue.

    A page whose body is only messages, or these and no more short lines than there are messages, is a case; one with
    a real body (a sentence, list or contact line besides) is not. A long line is a message if half of its sentences
    are, or a third with the first among them: a mention within a paragraph makes no message of it. Null and empty
    texts are no cases. Rows repeated with one id count once. Shuffled are the distinct masked lines of all pages, and
    names of lines (8 bytes) of the pages with messages."""
    return residue_cases(read_pages(df, id_col, text_col))


def residue_templates(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """template, bad, messages, pages: the templates of the lines of all pages, their verdicts, the number of their
    distinct messages and of the pages that hold one."""
    read = read_pages(df, id_col, text_col)
    mined = mine_templates(read.select(F.explode("new").alias("message")).distinct())
    of = mined.where("name is not null").select("name", "cluster")
    pages = read.select("id", F.explode("names").alias("name")).join(of, "name").groupBy("cluster").agg(F.countDistinct("id").alias("pages"))
    return mined.where("name is null").select("cluster", "template", "bad", F.col("n").alias("messages")).join(pages, "cluster").drop("cluster")
