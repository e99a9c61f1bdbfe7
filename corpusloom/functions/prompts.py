"""Column functions that write prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CONTEXT = "(no retrieved context provided)"


def answer_system(subject: str = "the given documents") -> str:
    return (
        f"You answer factual questions about {subject}.\n"
        "Use the given context first. Be accurate, direct and short.\n"
        "Give one phrase or one sentence for a fact, and the exact date or year if one is asked for.\n"
        "Explain only where the question asks why or how, or for a description.\n"
        "Write at most 3 sentences.\n\n"
    )


def answer_user(question: Column, context: Column) -> Column:
    """The question and its context block; a null or empty one is named as missing."""
    block = F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(context)
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\n\nContext:\n"), block, F.lit("\n\nAnswer:"))


def answer_whole(question: Column, context: Column, subject: str = "the given documents") -> Column:
    """System and user part in one, for models without roles."""
    return F.concat(F.lit(answer_system(subject) + "\n\n"), answer_user(question, context))


def passage_system() -> str:
    return "Write passages to search with: short, of facts, with names, dates and places.\nName no sources, and express no doubt."


def passage_user(question: Column) -> Column:
    """A request for a passage to search with."""
    return F.concat(F.lit("Write a short factual passage that may answer the question, in one or two sentences.\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nPassage:"))


def training(question: Column, subject: str = "the given documents") -> Column:
    """What a model is trained to go on from; the wording is a fixed value, but for the subject."""
    return F.concat(F.lit(f"You are answering factual questions about {subject}.\nAnswer directly and concisely.\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer:"))
