"""Problem 4: the main body of pages, without the furniture of the site around it.

A page is brought into lines by the layout renderer (an HTML page by its tree; a page that is text already keeps its
lines). Each line gets a kind from its words and shape, lines form runs (menus, side boxes with their links), and a
small linear model over the kinds and shapes of a line and its neighbours, fitted on the labelled lines, decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches
from millrace.llm.layout import is_html, render, source_lines
from millrace.runtime import spread

_MENU = {
    "home", "about", "about us", "services", "departments", "residents", "business", "visitors", "government", "news", "calendar", "meetings",
    "elections", "transit", "jobs", "parks", "library catalog", "library", "records", "forms", "maps", "directory", "alerts", "pay a bill", "i want to…",
    "i want to...", "report a concern", "contact us", "events", "search", "menu", "toggle menu", "main menu", "login", "sign in", "register",
    "inicio", "noticias", "servicios", "departamentos", "residentes", "formularios", "empleos", "mapas", "directorio", "avisos", "calendario", "pagos",
    "menú", "buscar", "contacto", "gobierno", "negocios", "reuniones", "registros", "accueil", "actualités", "首页", "服务", "新闻", "目录",
}
_HEADS = {
    "quick links", "related pages", "related links", "related content", "contenido relacionado", "more from this department", "you might also like",
    "popular searches", "trending now", "latest headlines", "events near you", "upcoming meetings", "in this section", "also on this site", "top forms",
    "explore", "see also", "most read", "featured",
}
#: How lines of each kind begin, and what they hold.
_KINDS = {
    "skip": (r"(?:skip|jump|go) (?:to |navigation)|ir al contenido|back to top|(?:open|toggle) (?:search|menu)|search this site|text size|select language|sign in\b|\[image:|close this|volver arriba|aller au contenu", ()),
    "cookie": (r"privacy (?:banner|choices)|consent settings|tracking preferences", ("cookie", "your privacy choices", "store data on your device", "small files to remember", "analytics files")),
    "share": (r"like this\?|share (?:this|on)\b|copy link|compart|post to your|tell a friend|print \||send to phone|sign up for our newsletter|subscribe\b|suscr[ií]base|partager|tweet\b|pin it", ("social channels", "social media", "alerts by text")),
    "meta": (r"last (?:modified|updated)|page (?:last )?(?:reviewed|updated|id)\b|published (?:by|on)|posted (?:by|on)|content owner|tags?:|viewed \d|rate this page|\d+ comments?\b|was this page|updated on|última (?:actualización|modificación)|author:|por .* redacci", ("staff writer", "min read")),
    "ad": (r"(?:advertisement|sponsored|ad|anuncio|publicidad)\b ?[:|-]", ()),
    "link": (r"» |(?:read|learn|see) more\b|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d+:|leer más|más información sobre", ("(pdf", "(docx", "(xlsx")),
    "legal": (
        r"links to outside|documents may need|translation is automatic|no warranty|copyright\b|©|terms of (?:use|service)|site map|mailing list|powered by|website (?:designed|by)|este sitio es|disclaimer|privacy policy|(?:designed|hosted) by",
        ("not medical advice", "equal access", "equal opportunity", "public records rules", "seal used with", "all rights reserved", "derechos reservados", "accessibility statement", "| main line", "|main line"),
    ),
}
_STARTS = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in _KINDS.items()))
_HOLDS = [(w, k) for k, (_, ws) in _KINDS.items() for w in ws]
#: Lines longer than this are judged by their sentences.
_LONG = 140
_LIST = re.compile(r"^\s*(?:[-*•o·▪◦‣–✅✔☑👶🍼➤►]|\d{1,2}[.)])\s+\S")
_ENDS = tuple(e + q for e in ".!?。！？" for q in ("", "'", '"', "”", "’", ")"))
_SEPARATORS = re.compile(r"\s*(?:\||·|›|»|::|>|/|•)\s*")
_CONTACT = re.compile(r"\(?\d{3}\)?[-. –]?\d{3}[-. –]\d{4}|[\w.+-]+@[\w-]+\.|\b(call|llame|e-mail|email|correo|teléfono|program line|reach us)\b")
_BODY = ("sentence", "list", "contact", "title", "text")
NAMES = ("blank", "menu", "bar", "crumb", "head", *_KINDS, "list", "contact", "sentence", "title", "text")


_CACHED: dict[str, str] = {}


def clean(line: str) -> str:
    return " ".join(line.split()).lower()


def sentences(t: str) -> list[str]:
    """The sentences of a cleaned line."""
    t = t.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
    if not t.isascii():
        t = t.replace("。", "。\n").replace("！", "！\n").replace("？", "？\n")
    return [x for x in t.split("\n") if x]


def kind_of(line: str) -> str:
    """The kind of a line by its own words and shape."""
    if len(line) > 100:
        return _kind(line)
    kind = _CACHED.get(line)
    if kind is None:
        if len(_CACHED) > 200_000:
            _CACHED.clear()
        kind = _CACHED[line] = _kind(line)
    return kind


def _kind(line: str) -> str:
    t = clean(line)
    if not t:
        return "blank"
    if k := _furniture(t) if len(t) <= _LONG else _long_furniture(t):
        return k
    if _LIST.match(line):
        return "list"
    if len(t) < 160 and _CONTACT.search(t):
        return "contact"
    if len(t) > 120 or t.endswith(_ENDS):
        return "sentence"
    return "title" if len(t) <= 90 else "text"


def _furniture(t: str) -> str | None:
    """The kind of furniture a cleaned line is, if any. A long row of parts needs letters in most: figures make no path."""
    if t in _MENU:
        return "menu"
    if t in _HEADS:
        return "head"
    if m := _STARTS.match(t):
        return m.lastgroup
    for w, k in _HOLDS:
        if w in t:
            return k
    if t.startswith(("you are here", "usted está", "vous êtes ici")):
        return "crumb"
    if not t.endswith(_ENDS) and any(c in t for c in "|·›»>/•:"):
        parts = [x for x in _SEPARATORS.split(t) if x]
        if len(parts) > 2 and max(map(len, parts)) <= 40 and (len(t) <= _LONG or 2 * sum(any(map(str.isalpha, x)) for x in parts) > len(parts)):
            known = sum(x in _MENU for x in parts)
            return "bar" if known >= 2 and known * 2 >= len(parts) else "crumb"
    return None


def _long_furniture(t: str) -> str | None:
    """The kind of furniture a long line is: that of its first sentence, if at least half of its text is furniture; a
    mention of cookies within a paragraph makes no notice of it. A sentence that is long itself is judged by its start
    and its words."""
    own = sentences(t)
    kind = _furniture(own[0])
    if not kind or kind in ("menu", "head"):
        return None
    return kind if 2 * sum(len(x) for x in own if _furniture(x)) >= len(t) else None


def _kinds(lines: list[str], own: list[str] | None = None) -> tuple[list[int], list[int]]:
    """Of each non-blank line its place and the number of its kind (own: kinds of the lines by themselves, if known)."""
    kinds = list(own) if own else [kind_of(x) for x in lines]
    at = [i for i, k in enumerate(kinds) if k != "blank"]
    for a, i in enumerate(at):  # a word of menus that stands alone between lines of the body is a heading there
        if kinds[i] == "menu" and 0 < a < len(at) - 1 and kinds[at[a - 1]] in _BODY and kinds[at[a + 1]] in _BODY and clean(lines[i]) != "menu":
            kinds[i] = "title"
    return at, [_CODE[kinds[i]] for i in at]


_CODE = {k: i for i, k in enumerate(NAMES)}
_FIRM = {_CODE[k] for k in ("sentence", "list", "contact")}
_BODY_CODES = {_CODE[k] for k in _BODY}
_AFTER_BOX = _FIRM | {_CODE["text"]}
#: Neighbours whose kinds count: the line itself, the one before, ...
_NEAR = (0, -1, 1, -2, 2)


def _shapes(lines: list[str], at: list[int], codes: list[int]) -> list[tuple[float, ...]]:
    """What counts of each line besides kinds: 1, in a side box, before the body, length, first, last, after a blank
    line, last of a side box before the body, one of titles between furniture behind the body."""
    n = len(at)
    box, between = _boxes(codes), _between(codes)
    body = next((j for j in range(n) if codes[j] in _FIRM), n)
    return [
        (1.0, float(box[j]), float(j < body), min(len(lines[at[j]].strip()), 200) / 200, float(j == 0), float(j == n - 1), float(j > 0 and at[j] - at[j - 1] > 1), float(box[j] and j + 1 < n and codes[j + 1] in _AFTER_BOX), float(between[j]))
        for j in range(n)
    ]


def features(lines: list[str]) -> tuple[np.ndarray, list[int]]:
    """A row for each non-blank line, and the numbers of these lines (from 1)."""
    at, codes = _kinds(lines)
    n, k = len(at), len(NAMES)
    out = np.zeros((n, 5 * k + 9), np.float32)
    for j in range(n):
        for s, d in enumerate(_NEAR):
            if 0 <= j + d < n:
                out[j, s * k + codes[j + d]] = 1
    if n:
        out[:, 5 * k :] = _shapes(lines, at, codes)
    return out, [i + 1 for i in at]


def _between(codes: list[int]) -> list[bool]:
    """Whether each line belongs to titles that stand between furniture after the body has begun."""
    out, n, begun, j = [False] * len(codes), len(codes), False, 0
    while j < n:
        if codes[j] == _CODE["title"]:
            end = j
            while end < n and codes[end] == _CODE["title"]:
                end += 1
            if begun and codes[j - 1] not in _BODY_CODES and end < n and codes[end] not in _BODY_CODES:
                out[j:end] = [True] * (end - j)
            j = end
        else:
            begun |= codes[j] in _FIRM
            j += 1
    return out


def _boxes(codes: list[int]) -> list[bool]:
    """Whether each line lies in a side box: a run of links and titles with a head or a link before the line."""
    out, inside = [], False
    for c in codes:
        inside = c == _CODE["head"] or c == _CODE["link"] or (inside and c == _CODE["title"])
        out.append(inside)
    return out


#: What is fitted on, at most: lines with a label, by page_id.
LABELLED_LINES = 20_000


def fit(labelled: list[tuple[int, str, dict[int, bool]]], rounds: int = 400) -> np.ndarray:
    """Weights of a logistic model from pages (id, text, line number -> is main), with the kinds' own evidence as the
    prior, so that kinds without labels are still decided."""
    k = len(NAMES)
    prior = np.zeros(5 * k + 9, np.float32)
    for name in NAMES:
        prior[NAMES.index(name)] = 3.0 if name in _BODY else -4.0
    prior[5 * k + 1] = -4.0
    prior[5 * k + 8] = -4.0
    xs, ys = [], []
    for _, text, labels in labelled:
        x, nos = features(visible_lines(text))
        if is_html(text):
            own = [[labels[no] for no in of if no in labels] for of in source_lines(text)]
            labels = {j + 1: any(v) for j, v in enumerate(own) if v}
        for row, no in zip(x, nos):
            if no in labels:
                xs.append(row)
                ys.append(labels[no])
    if not xs:
        return prior
    x, y, w = np.array(xs), np.array(ys, np.float32), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 0.002 * (w - prior))
    return w


def visible_lines(text: str) -> list[str]:
    return (render(text) if is_html(text) else text).split("\n")


def text_verdicts(text: str, weights: np.ndarray, lines: list[str] | None = None, kinds: list[str] | None = None) -> list[tuple[int, bool]]:
    """(number from 1, whether main) of each non-blank line of a text as it is. A line of HTML is main if any rendered
    line with text of it is; one that shows nothing is not. lines, kinds: of the visible text, if known."""
    if not is_html(text):
        return score_pages([lines or text.split("\n")], weights, [kinds])[0]
    of = source_lines(text)
    main = {no for j, m in is_main(render(text).split("\n"), weights) if m for no in of[j - 1]}
    return [(no, no in main) for no, x in enumerate(text.split("\n"), 1) if x.strip()]


def is_main(lines: list[str], weights: np.ndarray) -> list[tuple[int, bool]]:
    """(number from 1, whether main) of each non-blank line; the same sums as features(lines) @ weights."""
    return score_pages([lines], weights)[0]


def score_pages(pages: list[list[str]], weights: np.ndarray, kinds: list[list[str] | None] | None = None) -> list[list[tuple[int, bool]]]:
    k = len(NAMES)
    w = weights.tolist()
    near = [w[s * k : (s + 1) * k] for s in range(5)]
    rest = w[5 * k :]
    out = []
    for lines, known in zip(pages, kinds or [None] * len(pages)):
        at, codes = _kinds(lines, known)
        n = len(at)
        own = []
        for j, shape in enumerate(_shapes(lines, at, codes)):
            x = sum(a * b for a, b in zip(shape, rest)) + near[0][codes[j]]
            if j > 0:
                x += near[1][codes[j - 1]]
                if j > 1:
                    x += near[3][codes[j - 2]]
            if j + 1 < n:
                x += near[2][codes[j + 1]]
                if j + 2 < n:
                    x += near[4][codes[j + 2]]
            own.append((at[j] + 1, x > 0))
        out.append(own)
    return out


def load_labels(pages: DataFrame, labels: DataFrame, most: int = LABELLED_LINES) -> list[tuple[int, str, dict[int, bool]]]:
    """The labelled lines, at most `most` by page_id and line_no, with the texts of their pages."""
    some = labels.select(F.col("page_id").cast("long").alias("page_id"), "line_no", "is_main").where("page_id is not null and line_no is not null and is_main is not null").orderBy("page_id", "line_no").limit(most)
    rows = some.collect()
    ids = sorted({r[0] for r in rows})
    texts = dict(pages.where(F.col("page_id").isin(ids)).select("page_id", "text").where("text is not null").collect()) if ids else {}
    by: dict[int, dict[int, bool]] = {}
    for p, no, main in rows:
        by.setdefault(p, {})[no] = main
    return [(p, texts[p], d) for p, d in sorted(by.items()) if p in texts]


def fitted(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", text_col: str = "text") -> np.ndarray:
    """The weights fitted on the labels of pages."""
    return fit(load_labels(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("text")), labels))


def line_verdicts(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, line_no, is_main of each non-blank line of each page; texts that are null or blank give no rows.

    Labels are (page_id, line_no, is_main) of some pages of the same table, at most LABELLED_LINES of them are used;
    without any, the kinds alone decide. No shuffle: the weights, a few dozen numbers, go to every task. Repeated rows
    give repeated results."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("text"))
    weights = fitted(named, labels, "page_id", "text")

    def of(b: pa.RecordBatch):
        cols: tuple[list, ...] = ([], [], [])
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for no, main in text_verdicts(t, weights) if t else ():
                cols[0].append(i)
                cols[1].append(no)
                cols[2].append(main)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["id", "line_no", "is_main"])

    return map_batches(spread(named, "page_id"), of, "id long, line_no long, is_main boolean")


def main_bodies(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, body: the lines of the main body, in order; null for a null text, empty if nothing is left."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("text"))
    weights = fitted(named, labels, "page_id", "text")

    def of(b: pa.RecordBatch):
        out = []
        for t in b.column(1).to_pylist():
            lines = visible_lines(t or "")
            out.append(None if t is None else "\n".join(lines[no - 1] for no, main in is_main(lines, weights) if main))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "body"])

    return map_batches(spread(named, "page_id"), of, "id long, body string")
