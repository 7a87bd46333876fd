"""Row-level gates: is a link worth fetching, is a page a program page, is a value filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.terms import held_terms

# Word lists that decide results. Entries with a hyphen or an underscore, which pieces of a path never
# have, are left out of the two lists of segments.
GOOD_SEGMENTS = ["wic", "maternal", "prenatal", "perinatal", "mcah", "mch", "infant", "postpartum", "breastfeed", "lactation", "reproductive", "newborn", "pregnancy", "birth", "doula", "midwife", "obstetric", "miechv"]
BAD_SEGMENTS = ["login", "logout", "admin", "news", "blog", "announcement", "event", "calendar", "permit", "license", "fee", "job", "career", "employment", "bid", "rfp", "procurement", "agendas", "minutes", "board", "meeting", "facebook", "twitter", "instagram", "youtube", "linkedin", "donate", "volunteer", "#"]
GENERIC_TEXTS = ["skip to main content", "skip to content", "click here to learn more", "click here", "learn more", "read more", "find out more", "more information", "staff login", "login", "sign in", "back to top", "print this page", "share", "email this page", "home", "contact us", "sitemap", "accessibility"]
INDICATORS = ["eligibility", "how to apply", "to apply", "application", "services include", "program provides", "program offers", "to enroll", "enrollment", "contact us", "call us", "phone:", "hours:", "location:", "address:", "pregnant", "prenatal", "postpartum", "infant", "newborn"]
FEWER_INDICATORS = [x for x in INDICATORS if x not in ("contact us", "call us")]
SOCIAL_HOSTS = ["facebook.com", "twitter.com", "instagram.com", "youtube.com"]
ELIGIBILITY_WORDS, APPLY_WORDS = ["eligibility", "qualify", "requirements"], ["apply", "application", "how to", "enroll"]
BASIC_KEYWORDS = ["wic", "prenatal", "postpartum", "pregnancy", "maternal", "mch", "mcah", "perinatal", "home visiting", "doula", "midwife", "midwifery", "breastfeeding", "lactation", "black infant health", "bih", "healthy start", "first 5", "teen pregnancy", "title v", "family planning", "reproductive health"]
PLACEHOLDERS = ["not found", "not specified", "", "none", "n/a"]
CRITICAL_PLACEHOLDERS = ["Not specified", "Not found", ""]


def url_gate(url: Column, link_text: Column, aliases: list[str] | tuple[Column, Column], good: list[str] = GOOD_SEGMENTS, bad: list[str] = BAD_SEGMENTS) -> Column:
    """struct<keep, reason>: an ordered list of decisions, the first that applies counts. Texts and paths are lowered
    once. Path pieces match whole dictionary entries only. aliases: a fixed list, or the arrays that held_terms made of
    the link's text and (with hyphens or underscores for spaces) of the path."""
    text, path, parts = F.trim(F.lower(F.coalesce(link_text, F.lit("")))), T.url_path(url), T.path_parts(url)
    say = lambda keep, why: F.struct(F.lit(keep).alias("keep"), F.lit(why).alias("reason"))
    if isinstance(aliases, tuple):
        aliases, in_path = aliases[0], F.size(aliases[1]) > 0
    else:
        in_path = T.holds_any(path, [a.replace(" ", x) for a in aliases for x in "-_"])
    return (
        F.when(F.coalesce(~F.lower(url).startswith("http"), F.lit(True)), say(False, "invalid url"))
        .when(text.isin(*GENERIC_TEXTS), say(False, "generic link text"))
        .when(F.length(text) < 3, say(False, "link text too short"))
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, bad))), say(False, "bad url segment"))
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, good))), say(True, "good url segment"))
        .when(T.holds_any(text, aliases), say(True, "alias in link text"))
        .when(in_path, say(True, "alias in url path"))
        .when(F.size(T.words(text)) >= 4, say(True, "substantive link text"))
        .otherwise(say(True, "low confidence"))
    )


def content_score(lowered: Column, aliases: list[str] | Column, indicators: list[str] = INDICATORS) -> Column:
    """Number of aliases in the lowered text, and one more if it holds at least three indicators."""
    return T.n_held(lowered, aliases) + (T.n_held(lowered, indicators) >= 3).cast("int")


def page_gate(df: DataFrame, aliases: list[str] | DataFrame, text_col: str = "text", least_chars: int = 200, least_score: int = 1) -> DataFrame:
    """df with score, is_program_page, reason. The length is tested before the dictionary (a fixed list, or a table of
    any size) is scanned."""
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    if isinstance(aliases, DataFrame):
        low = held_terms(low, F.when(F.length("_low") >= least_chars, F.col("_low")), aliases, "_held")
        aliases = F.col("_held")
    score = F.when(F.length("_low") >= least_chars, content_score(F.col("_low"), aliases)).otherwise(0)
    reason = F.when(F.length("_low") < least_chars, "page too short").when(F.col("score") < least_score, "no registry signal").otherwise("program page")
    return low.withColumn("score", score).withColumn("reason", reason).withColumn("is_program_page", F.col("reason") == "program page").drop("_low", "_held")


def link_score(url: Column, link_text: Column, aliases: list[str] | Column, keywords: list[str] | Column, excluded: list[str], skip: list[str] = BAD_SEGMENTS) -> Column:
    """0 for skipped paths and texts; else 3 for an alias, 2 and the relevance for keywords, -5 for social hosts, -3 for
    excluded words without keywords."""
    both = F.lower(F.concat_ws(" ", F.coalesce(link_text, F.lit("")), F.coalesce(url, F.lit(""))))
    maternal = T.holds_any(both, keywords)
    scored = (
        F.when(T.holds_any(both, aliases), 3.0).otherwise(0.0)
        + F.when(maternal, 2.0 + relevance(both, keywords)).otherwise(0.0)
        - F.when(T.holds_any(F.coalesce(url, F.lit("")), SOCIAL_HOSTS), 5.0).otherwise(0.0)
        - F.when(T.holds_any(both, excluded) & ~maternal, 3.0).otherwise(0.0)
    )
    skipped = F.arrays_overlap(T.path_parts(F.coalesce(url, F.lit(""))), F.array(*map(F.lit, skip))) | F.trim(F.lower(F.coalesce(link_text, F.lit("")))).isin("", *GENERIC_TEXTS)
    return F.when(skipped, 0.0).otherwise(scored)


def relevance(lowered: Column, keywords: list[str] | Column) -> Column:
    """Hits of keywords over five, 1 at most; a keyword listed twice counts twice."""
    return F.least(F.lit(1.0), T.n_held(lowered, keywords) / 5.0)


def tiered_link_score(url: Column, link_text: Column, base: Column, tiers: list[tuple[list[str], float]], external: float = 2.0) -> Column:
    """The weights of the tiers whose words the link holds, less a penalty for another host; 0 at least."""
    both = F.lower(F.concat_ws(" ", F.coalesce(link_text, F.lit("")), F.coalesce(url, F.lit(""))))
    total = F.lit(0.0)
    for terms, weight in tiers:
        total = total + F.when(T.holds_any(both, terms), weight).otherwise(0.0)
    outside = (T.url_host(url) != "") & (T.url_host(url) != T.url_host(base))
    return F.greatest(F.lit(0.0), total - F.when(outside, external).otherwise(0.0))


def page_class_score(lowered: Column, keywords: list[str] | Column) -> Column:
    """2 for each keyword, 3 for eligibility, 3 for how to apply; a program page has 5."""
    return T.n_held(lowered, keywords) * 2.0 + F.when(T.holds_any(lowered, [*ELIGIBILITY_WORDS, "who can"]), 3.0).otherwise(0.0) + F.when(T.holds_any(lowered, [*APPLY_WORDS, "register"]), 3.0).otherwise(0.0)


def missing_signals(lowered: Column, has_contact: Column) -> Column:
    return F.array_compact(F.array(F.when(~T.holds_any(lowered, ELIGIBILITY_WORDS), F.lit("eligibility")), F.when(~T.holds_any(lowered, APPLY_WORDS), F.lit("apply")), F.when(~has_contact, F.lit("contact"))))


def is_filled(c: Column) -> Column:
    """Not null and no placeholder, in any case, trimmed."""
    return F.coalesce(~F.trim(F.lower(c)).isin(*PLACEHOLDERS), F.lit(False))


def is_critical_missing(c: Column) -> Column:
    """A placeholder as written: case and white space count."""
    return F.coalesce(c.isin(*CRITICAL_PLACEHOLDERS), F.lit(True))


def is_pdf_link(url: Column, anywhere: bool = False) -> Column:
    u = F.lower(url)
    return u.contains("pdf") if anywhere else u.rlike(r"\.pdf$|/pdf")


def is_gov(url: Column) -> Column:
    return T.url_host(url).rlike(r"\.(gov|us)$")


#: Last pieces of paths that are plain words by right (fixed values).
PLAIN_SLUGS = ["mcah", "mch", "wic", "nursing", "health", "programs", "services", "families", "children", "women", "program", "home", "birth"]
#: Markers of a firewall's refusal, anywhere in a page (fixed values).
FIREWALL_MARKERS = ["$(serve_403)", "reference #18."]


def is_plain_slug(url: Column) -> Column:
    """Whether the last piece of a path is a bare word, as of a URL cut off: letters only, four at least, no known one."""
    last = F.element_at(F.split(F.regexp_replace(T.url_path(url), "/+$", ""), "/"), -1)
    return last.rlike("^[a-z]{4,}$") & ~last.isin(*PLAIN_SLUGS)


def is_refused(text: Column) -> Column:
    """A firewall's markers anywhere in the text."""
    return T.holds_any(F.lower(F.coalesce(text, F.lit(""))), FIREWALL_MARKERS)


def is_challenge_page(text: Column) -> Column:
    """An interstitial of a firewall: its phrases in the first 500 characters."""
    return T.holds_any(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500)), ["just a moment", "checking your browser", "not a robot", "access denied", "attention required"])
