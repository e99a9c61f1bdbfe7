"""Column functions for questions: classes and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: markers of the question classes
PLURAL = ("what are", "who are", "which are", "list ", "name the", "what were", "who were", "which teams", "which events")
SINGULAR = ("what is", "what was", "who is", "who was", "where is", "where was", "when was", "when did", "what year", "what date", "what month")
FACTOID = ("what is", "what was", "what are", "what were", "who is", "who was", "who are", "which ", "where ", "when ", "how many ", "how much ", "name ", "list ", "identify ")
EXPLANATORY = ("what happened", "describe", "explain", "significance", "importance", "impact", "role", "reason", "history of")
REWRITES = (("when was ", "in what year was "), ("when did ", "in what year did "), ("where is ", "what is the location of "))


def _starts(q: Column, markers) -> Column:
    return F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.startswith(q, m))


def classes(question: Column) -> dict[str, Column]:
    """Flags of a question's classes; a null or empty question has none."""
    q = F.lower(T.strip(question))
    some = F.coalesce(question, F.lit("")) != ""
    counting = _starts(q, ("how many ", "how much "))
    explanatory = some & ~counting & (_starts(q, ("why ", "how ")) | F.exists(F.array(*(F.lit(m) for m in EXPLANATORY)), lambda m: F.contains(q, m)))
    plural = some & _starts(q, PLURAL)
    return {
        "is_plural": plural,
        "is_singular_fact": some & ~plural & _starts(q, SINGULAR),
        "is_explanatory": explanatory,
        "is_factoid": some & ~explanatory & _starts(q, FACTOID),
        "is_year": some & (F.contains(q, F.lit("what year")) | (F.startswith(q, F.lit("when ")) & F.contains(q, F.lit("year")))),
        "is_when": some & F.startswith(q, F.lit("when ")),
    }


def rewrites(question: Column, most: int = 2) -> Column:
    """Other wordings of a question, without repetitions: a rewritten opening, then its first eight terms if there are two."""
    q = T.normalize_whitespace(question)
    low = F.lower(q)
    opening = F.lit(None).cast("string")
    for old, new in reversed(REWRITES):
        opening = F.when(F.startswith(low, F.lit(old)), F.concat(F.lit(new), F.substring(q, F.lit(len(old) + 1), F.length(q)))).otherwise(opening)
    terms = T.query_terms(q)
    listed = F.when(F.size(terms) >= 2, F.array_join(F.slice(terms, 1, 8), " "))
    found = F.filter(F.array(opening, listed), lambda v: v.isNotNull() & (F.lower(v) != low))
    return F.slice(F.filter(found, lambda v, i: (i == 0) | (F.lower(v) != F.lower(F.get(found, F.lit(0))))), 1, most)


def augmentations(question: Column, most: int = 2) -> Column:
    """Other searches for a question, without repetitions: without its opening, its capitalised phrases, its first ten terms if there are two."""
    q = T.normalize_whitespace(question)
    stem = F.regexp_replace(F.regexp_replace(q, r"(?i)^(what|when|where|who|which|how many|how much)\s+(is|was|are|were|did|does|do)?\s*", ""), r"^[ ?]+|[ ?]+$", "")
    phrases = F.regexp_extract_all(q, F.lit(r"(?U)\b(?:[A-Z][A-Za-z0-9&.\-']*(?:\s+[A-Z][A-Za-z0-9&.\-']*){0,6})\b"), F.lit(0))
    phrases = F.filter(phrases, lambda p: ~F.lower(p).isin("what", "when", "where", "who", "which", "how"))
    terms = T.query_terms(q)
    listed = F.when(F.size(terms) >= 2, F.array(F.array_join(F.slice(terms, 1, 10), " "))).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.concat(F.array(stem), phrases, listed), lambda v: (v != "") & (F.lower(v) != F.lower(q)))
    first = lambda vs: F.filter(vs, lambda v, i: F.array_position(F.transform(vs, F.lower), F.lower(v)) == i + 1)
    return F.slice(F.get(F.transform(F.array(found), first), F.lit(0)), 1, most)
