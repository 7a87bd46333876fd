"""Column functions over text, URLs and lists. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as punctuation in names (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Patterns of contacts (fixed values).
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def collapse(c: Column) -> Column:
    """Runs of white space (ASCII) as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    return collapse(F.translate(F.lower(c), PUNCTUATION, ""))


def tokens(c: Column, least: int) -> Column:
    """The words of at least `least` letters a-z, in order, with repetitions."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([a-z]{{{least},}})"), F.lit(1))


def words(c: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.filter(F.split(collapse(F.lower(c)), " "), lambda w: w != "")


def slugify(c: Column, cap: int | None = 60, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, cap) if cap else s
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def fingerprint(c: Column, first: int = 2000) -> Column:
    """SHA-1 of the first characters, white space collapsed, in lower case."""
    return F.sha1(F.lower(collapse(F.substring(c, 1, first))).cast("binary"))


def phones(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({PHONE})"), F.lit(1))))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1))))


def phone_key(c: Column) -> Column:
    """A phone number without hyphens, brackets and spaces."""
    return F.translate(c, "-() ", "")


def url_key(c: Column) -> Column:
    """A URL in lower case without query, fragment and final slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[?#].*$", ""), "/+$", "")


def url_host(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(c: Column) -> Column:
    """The pieces of a URL's path between / - _ and points; a dictionary entry that holds one of these can't match."""
    return F.filter(F.split(url_path(c), r"[/\-_.]"), lambda x: x != "")


def same_domain(base: Column, other: Column) -> Column:
    b, o = url_host(base), url_host(other)
    return (b == o) | o.endswith(F.concat(F.lit("."), b))


def holds_any(c: Column, terms: list[str] | Column) -> Column:
    """Whether the text holds a term of a fixed list; terms may also be the array that held_terms made of the text."""
    if isinstance(terms, Column):
        return F.size(terms) > 0
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def held(c: Column, terms: list[str]) -> Column:
    """The terms that the text holds, in the order of the list."""
    return F.array_compact(F.array(*[F.when(c.contains(t), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def n_held(c: Column, terms: list[str] | Column) -> Column:
    if isinstance(terms, Column):
        return F.size(terms)
    out = F.lit(0)
    for t in terms:
        out = out + c.contains(t).cast("int")
    return out


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of the sets of words of two names; 1 if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(normalize_name(c), " "), lambda w: w != "")) for c in (a, b))
    common = F.size(F.array_intersect(x, y)).cast("double")
    p, r = common / F.nullif(F.size(x), F.lit(0)), common / F.nullif(F.size(y), F.lit(0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def zip_code(c: Column) -> Column:
    """The five digits of a text that is a ZIP code, with or without its four digits; else null."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^(\d{5})(?:-\d{4})?$", 1), F.lit(""))


def agent_text(c: Column, most: int = 5000) -> Column:
    """White space collapsed, at most so many characters."""
    return F.substring(collapse(c), 1, most)


def agent_emails(c: Column, most: int = 5) -> Column:
    """The first of the e-mail addresses between word boundaries, in order (pattern: fixed value, its stray | included)."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b)"), F.lit(1)))), 1, most)


def list_or_scalar(c: Column) -> Column:
    """A JSON list of texts as an array, any other text as an array of itself; null and blank texts as an empty one."""
    listed = F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(c)))


def clamped(c: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    """A text as a number within bounds; the default if it is none."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c.try_cast("double"), F.lit(default))))


def run_id(at: Column, commit: str, config: str) -> Column:
    """Time stamp, commit and eight digits of the configuration's hash."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(commit[:7]), F.substring(F.md5(F.lit(config).cast("binary")), 1, 8))


def services(c: Column) -> Column:
    """The parts of a list written with semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
