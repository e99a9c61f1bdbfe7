"""Column functions for text: white space, quality ratios, tokens, sentences, URLs."""

from __future__ import annotations

import mimetypes
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import MANY, contains_any

# fixed values: words that query terms leave out
STOPWORDS = (
    "what", "which", "when", "where", "who", "whom", "whose", "that", "this", "with", "from", "about", "into", "after", "before",
    "between", "their", "there", "these", "those", "have", "has", "were", "was", "been", "being", "and", "the", "for", "are", "but",
    "not", "did", "does", "is", "at", "in", "on", "by", "of", "to",
)

_TOKEN = re.compile("[a-z0-9]+")
_PLAIN = re.compile(r"[A-Za-z0-9 _/:;,'\"<>=!@#%&~`-]+")


def strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(c) -> Column:
    """Unicode compatibility composition, which no built-in function gives; a null is empty."""
    return _nfkc(F.coalesce(c, F.lit("")))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalize_whitespace(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_basic(c) -> Column:
    """NFKC, non-breaking spaces to spaces, three or more line ends to two, runs of blanks to one, stripped."""
    c = F.translate(nfkc(c), "\u00a0", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]+", " "))


def words(c) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def search_tokens(c) -> Column:
    """Runs of ASCII letters and digits of the NFKC text in lower case; all else separates."""
    return F.filter(F.split(F.lower(nfkc(c)), "[^a-z0-9]+"), lambda w: w != "")


def tokens_of(text: str | None) -> list[str]:
    """search_tokens of one text, for use within tasks."""
    if not text:
        return []
    return _TOKEN.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def query_terms(c) -> Column:
    """Tokens of four characters or more that are no stop words; repeated ones stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))


def sentences(c) -> Column:
    """Split after . ! or ? and white space before a capital, digit or quote."""
    parts = F.split(strip(c), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def dense_length(c) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def _share(c, other: str) -> Column:
    return let(dense_length(c), lambda n: F.when(n > 0, F.length(F.regexp_replace(F.coalesce(c, F.lit("")), other, "")) / n).otherwise(F.lit(0.0)))


def alpha_ratio(c) -> Column:
    return _share(c, r"[^\p{L}]+")


def digit_ratio(c) -> Column:
    return _share(c, r"[^\p{Nd}]+")


def repeat_line_ratio(c) -> Column:
    """Share of the most frequent line among lines that aren't empty; 0 below four lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), normalize_whitespace), lambda x: x != "")

    def run(acc, line):
        return let(F.when(acc["line"] == line, acc["run"] + 1).otherwise(1), lambda n: F.struct(line.alias("line"), n.alias("run"), F.greatest(acc["best"], n).alias("best")))

    def most(lines):
        # a line's count is the length of its run in the sorted lines
        start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))
        return F.when(F.size(F.array_distinct(lines)) == F.size(lines), 1).otherwise(F.aggregate(F.array_sort(lines), start, run, lambda acc: acc["best"]))

    return let(lines, lambda x: F.when(F.size(x) >= 4, most(x) / F.size(x)).otherwise(F.lit(0.0)))


def matches_any(c, patterns) -> Column:
    """Whether one of the patterns is found, in any case of letters; those that aren't valid are left out.

    Patterns that are plain words are looked for together, whatever their number.
    """
    text, plain, others = F.coalesce(c, F.lit("")), [], []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        (plain if _PLAIN.fullmatch(p) else others).append(p)
    if len(plain) < MANY:
        plain, others = [], plain + others
    found = contains_any(F.lower(text), [p.lower() for p in plain]) if plain else F.lit(False)
    for p in others:
        found = found | text.rlike(f"(?i){p}")
    return found


def safe_name(c, lower: bool = False) -> Column:
    """Letters, digits, dots, underscores and hyphens; all else is an underscore, none at the ends."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.lower(name) if lower else name


def hash_id(c, n: int = 16) -> Column:
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, n)


def canonical_url(c, allow_query: bool = False) -> Column:
    """Without fragment, scheme and host in lower case, "/" for an empty path, else one trailing "/" less, query dropped unless allowed."""
    part = lambda k: F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    path = F.when(part(3).isin("", "/"), "/").otherwise(F.regexp_replace(part(3), "/$", ""))
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, part(4) if allow_query else F.lit(""))


def host(c) -> Column:
    return F.lower(F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1))


def domain_allowed(c, domains: list[str]) -> Column:
    """The host, with its port, is one of the domains or ends in one of them after a dot."""
    allowed = F.array(*(F.lit(d) for d in domains))
    return F.exists(allowed, lambda d: (host(c) == d) | F.endswith(host(c), F.concat(F.lit("."), d)))


def passes_filters(c, prefixes=(), substrings=(), deny_substrings=(), deny_patterns=()) -> Column:
    """A URL that begins with one of the prefixes and holds one of the substrings, where such are given, and none of what is denied."""
    url = F.coalesce(c, F.lit(""))
    some = lambda test, values: F.exists(F.array(*(F.lit(v) for v in values)), test)
    ok = F.lit(True)
    if prefixes:
        ok = ok & some(lambda v: F.startswith(url, v), prefixes)
    if substrings:
        ok = ok & some(lambda v: F.contains(url, v), substrings)
    if deny_substrings:
        ok = ok & ~some(lambda v: F.contains(url, v), deny_substrings)
    for pattern in deny_patterns:
        ok = ok & ~url.rlike(pattern)
    return ok


@cache
def extensions() -> dict[str, str]:
    """File extension of each content type that Python's own table has."""
    known = mimetypes.MimeTypes()
    return {kind: known.guess_extension(kind) for kind in sorted(set(known.types_map[True].values()))}


def guess_extension(url, content_type) -> Column:
    """.html or .pdf by content type, else the path's own extension, else the content type's, else .bin."""
    mime = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    own = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]+)$", 1))
    known = F.create_map(*(F.lit(v) for pair in extensions().items() for v in pair))
    return (
        F.when(mime.isin("text/html"), ".html")
        .when((mime == "application/pdf") | F.endswith(F.lower(F.coalesce(url, F.lit(""))), F.lit(".pdf")), ".pdf")
        .when(own != "", own)
        .otherwise(F.coalesce(F.element_at(known, mime), F.lit(".bin")))
    )


def chunk_id(doc_id, index, text) -> Column:
    return F.concat_ws("_", doc_id, index.cast("string"), hash_id(text, 10))
