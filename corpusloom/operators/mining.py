"""Questions and answers mined from sentences of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.patterns import contains_any

# fixed values: parts of answers and entities that aren't used, paths of scraped pages, and the patterns of sentences that answer a question
BAD_ANSWERS = ("click here", "read more", "learn more", "copyright", "all rights reserved")
BAD_ENTITIES = ("blog", "insider", "guide", "visit pittsburgh", "wikipedia", "about us", "things to do", "best ", "top ", "free things", "contact us", "privacy", "terms", "cookie", "site map", "sitemap", "index")
SCRAPED_PATHS = ("data/raw/", "data-raw/")
VERBS = "founded|established|formed|created|chartered|opened|launched|began"
DATED = rf"(?i)\b(?:{VERBS})\b[^.]{{0,80}}?\b(?:in|on)\s+((?:[A-Z][a-z]+\s+\d{{1,2}},\s+\d{{4}})|(?:\d{{4}}))\b"
FOUND = (
    (r"(?i)\bis located in\s+([^.;\n]{3,100})", "Where is ", " located?"),
    (r"(?i)\bis located at\s+([^.;\n]{3,100})", "Where is ", " located?"),
    (r"(?i)\bheadquartered in\s+([^.;\n]{3,100})", "Where is ", " headquartered?"),
    (r"(?i)\bfounded by\s+([^.;\n]{2,100})", "Who founded ", "?"),
    (r"(?i)\bmascot(?:\s+name)?\s+(?:is|was)\s+([^.;\n]{2,80})", "What is the mascot of ", "?"),
)


@F.arrow_udf(StringType())
def _title_case(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None else t.title() for t in text.to_pylist()], pa.string())


def clean_answer(c) -> Column:
    """One line without [n] marks and without separators at its ends."""
    bare = T.strip(F.regexp_replace(T.normalize_whitespace(c), r"\[[0-9]+\]", ""))
    return T.normalize_whitespace(F.regexp_replace(bare, r"^[ \t,;:.]+|[ \t,;:.]+$", ""))


def entity(title, url, suffixes: str | None = None) -> Column:
    """What a document is about: its title before "|" and " - ", without a site's suffix (a pattern), else the address's last part."""
    name = T.strip(F.element_at(F.split(T.normalize_whitespace(title), r"\|"), 1))
    name = T.strip(F.regexp_replace(name, suffixes, "")) if suffixes else name
    name = T.strip(F.element_at(F.split(name, " - "), 1))
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "^/+|/+$", ""), "/"), -1)
    slug = T.normalize_whitespace(F.regexp_replace(F.regexp_replace(last, "[-_]+", " "), r"(?i)\.(html?|php)$", ""))
    return F.when(name != "", name).when(slug != "", _title_case(slug)).otherwise("this organization")


def is_scraped(path) -> Column:
    return F.contains(F.coalesce(path, F.lit("")), F.lit(SCRAPED_PATHS[0])) | F.contains(F.coalesce(path, F.lit("")), F.lit(SCRAPED_PATHS[1]))


def _holds(c, parts) -> Column:
    return contains_any(F.lower(c), parts)


def good_answer(c) -> Column:
    return (F.length(c) >= 2) & (T.word_count(c) <= 12) & ~_holds(c, ("|", "http", "<", ">", *BAD_ANSWERS))


def good_entity(c, bad=BAD_ENTITIES) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & (T.word_count(c) <= 9) & ~_holds(c, bad)


def matches(name: Column, sentence: Column) -> Column:
    """array<struct<question, answer>> of the patterns that a sentence holds, in their order."""
    verb = F.lower(F.regexp_extract(sentence, rf"(?i)\b({VERBS})\b", 1))
    dated = F.when(verb == "began", F.concat(F.lit("When did "), name, F.lit(" begin?"))).otherwise(F.concat(F.lit("When was "), name, F.lit(" "), verb, F.lit("?")))
    rows = [F.struct(dated.alias("question"), F.regexp_extract(sentence, DATED, 1).alias("answer"))]
    rows += [F.struct(F.concat(F.lit(before), name, F.lit(after)).alias("question"), F.regexp_extract(sentence, p, 1).alias("answer")) for p, before, after in FOUND]
    return F.array(*rows)


def mine(docs: DataFrame, most: int = 300, only_scraped: bool = True, suffixes: str | None = None) -> DataFrame:
    """place, question, answer: the first `most` examples whose question is new, in order of documents, sentences and patterns.

    docs: ord (their order), text, title, source_url, source_path. Sentences 1 to 40 and 81 to 120 are looked at.
    """
    docs = docs.where(is_scraped(F.col("source_path"))) if only_scraped else docs
    rows = docs.withColumn("name", entity(F.col("title"), F.col("source_url"), suffixes)).where(good_entity(F.col("name")))
    parts = F.filter(F.transform(F.split(T.normalize_whitespace(F.col("text")), r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")
    rows = rows.select("ord", "name", F.posexplode(parts).alias("at", "sentence")).where("at < 40 or at between 80 and 119")
    rows = rows.select("ord", "at", F.posexplode(matches(F.col("name"), F.col("sentence"))).alias("pattern", "m")).where("m.answer <> ''")
    rows = rows.select("ord", "at", "pattern", T.normalize_whitespace(F.col("m.question")).alias("question"), clean_answer(F.col("m.answer")).alias("answer")).where(good_answer(F.col("answer")))
    first = rows.groupBy(F.lower("question").alias("key")).agg(F.min(F.struct("ord", "at", "pattern", "question", "answer")).alias("e"))
    kept = first.select("e.*").orderBy("ord", "at", "pattern").limit(most)
    return kept.select(F.row_number().over(Window.orderBy("ord", "at", "pattern")).alias("place"), "question", "answer")
