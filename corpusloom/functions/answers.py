"""Column functions that tidy a reader's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import questions as Q
from . import text as T

# fixed values: openings, separators, quotes, years, dates and parentheses of answers
OPENINGS = ("Answer:", "The answer is", "Based on the context,", "Based on the provided context,", "According to the context,", "According to the provided context,")
SEPARATORS = (" - ", " — ", " – ", " : ", ", because ", ", which ", ", who ", ", where ", ", and ")
UNKNOWN = ("unknown.", "unknown", "not found", "not provided", "insufficient information")
QUOTES = "[\"'“”‘’`]+"
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
DATE = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+\d{1,2},?\s+\d{4}\b"
PARENTHETICAL = r"^(.*?)\s*\((.*?)\)\s*$"

let = T.let


def unquote(c) -> Column:
    return T.strip(F.regexp_replace(T.strip(c), f"^{QUOTES}|{QUOTES}$", ""))


def simple_sentences(c) -> Column:
    """Split at white space after . ! or ?"""
    return F.filter(F.transform(F.split(T.strip(c), r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: s != "")


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), T.strip), lambda p: p != "")


def collapse_aliases(c: Column) -> Column:
    """A list by semicolons without repetitions; one part that another one contains stands for the list."""
    quoteless = lambda x: F.transform(_parts(x), unquote)
    distinct = lambda ps: F.filter(ps, lambda p, i: (i == 0) | ~F.exists(F.slice(ps, 1, F.greatest(i, F.lit(1))), lambda q: F.lower(q) == F.lower(p)))
    alias = lambda ps: F.get(F.filter(ps, lambda p: (p != "") & F.exists(ps, lambda q: (F.lower(q) != F.lower(p)) & F.contains(F.lower(q), F.lower(p)))), F.lit(0))
    chosen = let(let(quoteless(c), distinct), lambda ps: F.coalesce(alias(ps), F.array_join(ps, "; ")))
    return F.when(F.contains(c, F.lit(";")) & (F.size(_parts(c)) > 0), chosen).otherwise(c)


def collapse_parenthetical(c: Column) -> Column:
    """`left (inside)`: the one that the other contains, if one does."""
    sides = F.struct(unquote(F.regexp_extract(c, PARENTHETICAL, 1)).alias("l"), unquote(F.regexp_extract(c, PARENTHETICAL, 2)).alias("r"))
    inside = lambda a, b: F.contains(F.lower(b), F.lower(a))
    return let(sides, lambda s: F.when((s["l"] == "") | (s["r"] == ""), c).when(inside(s["l"], s["r"]), s["l"]).when(inside(s["r"], s["l"]), s["r"]).otherwise(c))


def drop_explanation(c: Column) -> Column:
    """What stands before the first separator in turn whose left side has 1 to 10 words and fewer than its right side."""

    def left(separator: Column) -> Column:
        at = F.instr(c, separator)
        sides = F.struct(F.substring(c, F.lit(1), at - 1).alias("l"), F.substring(c, at + F.length(separator), F.length(c)).alias("r"))
        good = lambda s: (at > 0) & T.word_count(s["l"]).between(1, 10) & (T.word_count(s["r"]) > T.word_count(s["l"]))
        return let(sides, lambda s: F.when(good(s), T.strip(s["l"])))

    found = F.filter(F.transform(F.array(*(F.lit(s) for s in SEPARATORS)), left), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), c)


def only_date(c: Column, is_year: Column, is_when: Column) -> Column:
    """The single year for questions of the year, else the single date or year for questions of when."""
    single = lambda pattern, group: let(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x: F.when(F.size(x) == 1, x[0]))
    date = T.normalize_whitespace(single(DATE, 0))
    return F.coalesce(F.when(is_year, single(YEAR, 1)).when(is_when, F.coalesce(F.nullif(date, F.lit("")), single(YEAR, 1))), c)


def postprocess(answer: Column, question: Column) -> Column:
    """The short form of an answer to a question; null and empty answers are ''. Without a question, one sentence at most is kept."""
    kinds = Q.classes(question)
    a = T.strip(answer)
    for opening in OPENINGS:
        a = F.regexp_replace(a, rf"(?is)\A{opening}[ :,\-]*(.*?)[ :,\-]*\z", "$1")
    a = T.strip(F.regexp_extract(a, "\\A[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0))
    a = F.regexp_replace(unquote(a), r"\A[ \t:,\-]+|[ \t:,\-]+\z", "")
    a = F.regexp_replace(a, r"(?:\s*\[\d+\])+$", "")
    a = let(a, collapse_aliases)
    a = let(a, lambda x: F.when(kinds["is_factoid"] & F.contains(x, F.lit(";")), F.coalesce(F.get(_parts(x), F.lit(0)), x)).otherwise(x))
    a = let(T.strip(a), collapse_parenthetical)
    a = let(a, drop_explanation)
    a = let(a, lambda x: only_date(x, kinds["is_year"], kinds["is_when"]))
    first = lambda x: F.get(simple_sentences(x), F.lit(0))
    a = let(a, lambda x: F.when(kinds["is_singular_fact"] & (F.size(simple_sentences(x)) > 1) & T.word_count(first(x)).between(1, 16), first(x)).otherwise(x))
    most = F.when(kinds["is_explanatory"], 3).when(kinds["is_factoid"], 2).otherwise(1)
    a = let(a, lambda x: F.when(F.size(simple_sentences(x)) > most, F.array_join(F.slice(simple_sentences(x), F.lit(1), most), " ")).otherwise(x))
    a = let(a, lambda x: F.when(F.lower(T.strip(x)).isin(*UNKNOWN), "UNKNOWN").otherwise(x))
    a = let(a, lambda x: F.when(T.word_count(x) <= 12, F.regexp_replace(x, r"[ .]+\z", "")).otherwise(x))
    return T.normalize_whitespace(a)
