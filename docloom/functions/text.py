"""Text scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the ones existing indexes and reports were made with.
TOKEN = r"c\+\+|[\p{L}\p{N}_]+(?:[-.+][\p{L}\p{N}_]+)*"
WORD = r"[a-z0-9_\-.]+"
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "with",
    "by", "of", "from", "as", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "this", "that", "these", "those",
    "it", "its", "they", "their", "them", "which", "who", "whom", "whose", "what",
    "where", "when", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "can", "will", "just", "should", "now",
)
QUERY_STOPWORDS = (
    "what", "is", "the", "for", "in", "how", "are", "do", "does", "to",
    "a", "an", "and", "or", "of", "with", "on", "at", "by", "from", "when",
)
POLICY_TERMS = (
    "security", "authentication", "password", "passwords", "mfa", "multi-factor",
    "token", "tokens", "encryption", "encrypted", "decrypt", "clearance", "confidential",
    "restricted", "public", "incident", "audit", "monitoring", "retention", "backup",
    "backups", "access", "login", "authorization", "privilege", "compliance",
    "repository", "repositories", "breach", "lockout", "policy", "identity",
)
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "fig.", "dr.", "mr.", "ms.", "prof.", "inc.", "corp.", "co.", "ltd.")
SENSITIVE = (
    "password", "passwd", "secret", "token", "authorization", "api_key", "apikey", "credential", "credentials",
    "private_key", "access_token", "refresh_token", "cookie", "session", "client_secret",
)
UI_SENSITIVE = ("password", "secret", "token", "authorization", "cookie", "key", "jwt")
REDACTED = "[REDACTED]"


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often it is used (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def tokens(text: Column, least: int = 1) -> Column:
    """TXT-01: lower-cased tokens in order; null text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    found = F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found
    return F.coalesce(found, empty_strings())


def words(text: Column) -> Column:
    """TXT-02: set of ASCII words."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), empty_strings()))


def trigrams(text: Column) -> Column:
    """TXT-03: set of character 3-grams after collapsing white space; shorter text is its own gram."""
    s = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """TXT-04: 0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def lexical_similarity(a: Column, b: Column) -> Column:
    """TXT-05: 0.7 words + 0.3 trigrams, 1 for equal trimmed text, to 4 places."""
    mixed = F.round(0.7 * jaccard(words(a), words(b)) + 0.3 * jaccard(trigrams(a), trigrams(b)), 4)
    return F.when((F.length(F.trim(a)) == 0) | (F.length(F.trim(b)) == 0), F.lit(0.0)).when(F.trim(a) == F.trim(b), F.lit(1.0)).otherwise(mixed)


def keyword_similarity(a: Column, b: Column) -> Column:
    """TXT-06: Jaccard of the policy terms among the words."""
    terms = F.array(*[F.lit(t) for t in POLICY_TERMS])
    return jaccard(F.array_intersect(words(a), terms), F.array_intersect(words(b), terms))


def normalize_heading(heading: Column) -> Column:
    """TXT-07: parts of a breadcrumb without numbering, in lower case; "general" if none is left."""
    number = r"(?i)^\s*(?:(?:Section|Chapter|Article|Clause|Part|Policy)\s+)?(?:\d+(?:\.\d+)*|[A-Z]\b|\([a-z0-9]+\))\s*[.:\-–]?\s*"
    parts = F.transform(F.split(F.coalesce(heading, F.lit("")), ">"), lambda p: F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(p), number, ""))), r"\s+", " "))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), " > ")
    return F.when(joined == "", "general").otherwise(joined)


def normalize_clause(text: Column) -> Column:
    """TXT-08: trimmed, lower case, single spaces, no emphasis marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "), r"[*_]{1,3}", "")


def sentences_simple(text: Column) -> Column:
    """CHK-03: split at white space after . ! or ?, trimmed, without empties."""
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentences(text: Column) -> Column:
    """TXT-09: as sentences_simple, but not after decimals and the listed abbreviations."""
    guard = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d+)\.(\d+)", "$1\u0002$2")
    s = F.regexp_replace(s, rf"(?i)\b({guard})(\s+)", "$1\u0003$2")  # a guard after the dot stops the split
    s = F.regexp_replace(s, r"([.!?])\s+", "$1\u0001")
    clean = lambda x: F.trim(F.translate(F.replace(x, F.lit("\u0002"), F.lit(".")), "\u0003", ""))
    return F.filter(F.transform(F.split(s, "\u0001"), clean), lambda x: x != "")


def query_keywords(query: Column) -> Column:
    """TXT-10: words of more than one character that are no stopwords."""
    return F.filter(F.array_except(words(query), F.array(*[F.lit(w) for w in QUERY_STOPWORDS])), lambda w: F.length(w) > 1)


def content_words(text: Column) -> Column:
    """TXT-11: content words for grounding."""
    found = F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\-]+"), 0), empty_strings()))
    return F.filter(F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS])), lambda w: F.length(w) > 1)


def citation_ids(text: Column) -> Column:
    """TXT-12: distinct sorted ids of bracketed citations; a-b is a range of at most 21 ids."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([\d\s,;\-]+)\]"), 1)
    span = r"^\s*(\d+)\s*-\s*(\d+)\s*$"

    def ids(g: Column) -> Column:
        a, b = (F.try_to_number(F.regexp_extract(g, span, k), F.lit("999999999")).cast("int") for k in (1, 2))
        ranged = F.when((a > 0) & (a <= b) & (b <= a + 20), F.sequence(a, b)).otherwise(F.expr("cast(array() as array<int>)"))
        parts = F.filter(F.split(F.trim(g), r"[,;\s]+"), lambda p: p.rlike(r"^\d{1,9}$"))
        return F.when(g.rlike(span), ranged).otherwise(F.transform(parts, lambda p: p.cast("int")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, ids))))


def escape_xml(text: Column) -> Column:
    """TXT-13: & < >, and with these every CDATA mark."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# Marks that evidence must not open or close.
EVIDENCE_MARKS = ("<evidence", "</evidence>", "<system_instructions>", "</system_instructions>", "<![CDATA[", "]]>")


def escape_evidence(text: Column) -> Column:
    """TXT-13: & and the marks of EVIDENCE_MARKS; other tags stay."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark in EVIDENCE_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark.replace("<", "&lt;").replace(">", "&gt;")))
    return out


def query_fingerprint(query: Column) -> Column:
    """TXT-14: null for blank queries."""
    s = F.regexp_replace(F.lower(F.trim(query)), r"\s+", " ")
    return F.when(s != "", F.concat(F.lit("sha256:"), F.sha2(s, 256)))


def redact(text: Column) -> Column:
    """TXT-15: bearer credentials first, then JWT-shaped strings."""
    s = F.regexp_replace(text, r"(?i)Bearer\s+[A-Za-z0-9\-_.]+", "Bearer " + REDACTED)
    return F.regexp_replace(s, r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "[REDACTED_JWT]")


def is_sensitive(key: Column, keys: tuple = SENSITIVE) -> Column:
    return F.replace(F.lower(key), F.lit("-"), F.lit("_")).rlike("|".join(keys))


def redact_map(data: Column, keys: tuple = SENSITIVE) -> Column:
    """TXT-16/23: values of sensitive keys are hidden, the other strings cleaned; for maps of strings."""
    return F.transform_values(data, lambda k, v: F.when(is_sensitive(k, keys), F.lit(REDACTED)).otherwise(redact(v)))


def redact_json(data: Column, keys: tuple = SENSITIVE, depth: int = 15, arrays: bool = True) -> Column:
    """TXT-16/23: JSON of any shape: values of sensitive keys are hidden, other strings cleaned, deeper levels cut.

    arrays=False leaves arrays as they are, as a viewer does. Text that is no JSON is cleaned as a string.
    """
    bearer, jwt = re.compile(r"Bearer\s+[A-Za-z0-9\-_.]+", re.I), re.compile(r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+")

    def clean(value, level: int):
        if level > depth:
            return "[TRUNCATED: MAX_DEPTH]"
        if isinstance(value, str):
            return jwt.sub("[REDACTED_JWT]", bearer.sub("Bearer " + REDACTED, value))
        if isinstance(value, dict):
            return {k: REDACTED if any(x in k.lower().replace("-", "_") for x in keys) else clean(v, level + 1) for k, v in value.items()}
        if isinstance(value, list) and arrays:
            return [clean(v, level + 1) for v in value]
        return value

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(clean(json.loads(text), 0), ensure_ascii=False)
        except ValueError:
            return clean(text, 0)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one, na_action="ignore")

    return run(data)


def file_name(name: Column) -> Column:
    """TXT-17: the last path part, other characters than letters, digits, dot, dash and underscore replaced."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def request_id(value: Column) -> Column:
    """TXT-18: a valid id stays, else a new random one."""
    return F.when(value.rlike(r"^[A-Za-z0-9_-]{1,64}$"), value).otherwise(F.replace(F.uuid(), F.lit("-")))


def format_bytes(n: Column) -> Column:
    """TXT-20."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))


def format_latency(ms: Column) -> Column:
    """TXT-20: milliseconds below a second, else seconds."""
    return F.when(ms.isNull(), "0 ms").when(ms < 1000, F.format_string("%.1f ms", ms.cast("double"))).otherwise(F.format_string("%.2f s", ms / 1000))


def format_percent(share: Column) -> Column:
    """TXT-20."""
    return F.when(share.isNull(), "0%").otherwise(F.format_string("%.1f%%", share * 100))


def short_hash(value: Column, lead: int = 8, trail: int = 6) -> Column:
    """TXT-20: the ends of a long hash."""
    return F.when(value.isNull(), "").when(F.length(value) <= lead + trail, value).otherwise(F.concat(F.left(value, F.lit(lead)), F.lit("..."), F.right(value, F.lit(trail))))


def first_sentence(text: Column) -> Column:
    """TXT-21."""
    return F.get(sentences_simple(text), F.lit(0))


def json_body(text: Column) -> Column:
    """TXT-22: the object inside code fences or prose, from the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
