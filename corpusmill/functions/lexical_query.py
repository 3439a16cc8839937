"""Turning questions into lexical queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import captured

# How a question names an article and a clause.
ARTICLE_ASKED = r"(?iU)\barticle\s+(\d+)\b"
CLAUSE_ASKED = r"(?iU)\b(?:clause|paragraph)\s+(\d+)\b"

# Words without search value in a general question.
GENERAL_STOPWORDS = (
    "a", "an", "and", "are", "article", "by", "clause", "does", "how", "is", "of", "paragraph",
    "the", "to", "what", "when", "who",
)

# Question boilerplate, corpus names and stop words of the legal corpus.
LEGAL_BOILERPLATE = (
    r"\bwhat is\b", r"\bwhat are\b", r"\bwhat does\b", r"\bhow does\b", r"\bwho is\b",
    r"\bwho are\b", r"\bwhen does\b", r"\baccording to\b", r"\bunder\b",
    r"\bdigital services act\b", r"\bthis regulation\b",
)
LEGAL_STOPWORDS = (
    "a", "an", "and", "article", "act", "by", "clause", "digital", "does", "how", "is", "of",
    "paragraph", "regulation", "services", "the", "this", "to", "what", "who",
)

QueryBuilder = Callable[[Column], Column]


def article_asked(question: Column) -> Column:
    """Number of the first article named in a question, or null."""
    return captured(question, ARTICLE_ASKED)


def clause_asked(question: Column) -> Column:
    """Number of the first clause or paragraph named in a question, or null."""
    return captured(question, CLAUSE_ASKED)


def query_terms(question: Column, removed: Sequence[str], stopwords: Sequence[str]) -> Column:
    """Distinct search words in order of appearance."""
    cleaned = F.lower(question)
    # What is taken out of a question besides its boilerplate.
    for pattern in (*removed, r"\barticle\s+\d+\b", r"\b(?:clause|paragraph)\s+\d+\b"):
        cleaned = F.regexp_replace(cleaned, f"(?U){pattern}", " ")
    cleaned = F.regexp_replace(cleaned, r"(?U)[^a-z0-9\s-]", " ")
    tokens = F.transform(
        F.split(cleaned, r"(?U)\s+"), lambda token: F.btrim(token, F.lit("-"))
    )
    return F.array_distinct(
        F.filter(
            tokens,
            lambda token: (token != "") & ~token.isin(*stopwords) & ~token.rlike("^[0-9]+$"),
        )
    )


def _lexical_query(question: Column, terms: Column, bm25: bool) -> Column:
    def joined(separator: str) -> Column:
        return F.nullif(F.array_join(terms, separator), F.lit(""))

    return F.struct(
        terms.alias("terms"),
        joined(" | ").alias("tsquery_text"),
        (joined(" ") if bm25 else F.lit(None).cast("string")).alias("match_text"),
        article_asked(question).alias("article_number"),
        clause_asked(question).alias("clause_number"),
    )


def general_query(question: Column) -> Column:
    """Builder for any task."""
    return _lexical_query(question, query_terms(question, (), GENERAL_STOPWORDS), bm25=True)


def legal_query(question: Column) -> Column:
    """Builder for the legal corpus; it gives no BM25 text, so BM25 search falls back to a listing."""
    return _lexical_query(question, query_terms(question, LEGAL_BOILERPLATE, LEGAL_STOPWORDS), bm25=False)


def build_lexical_query(
    question: Column, task: Column, builders: Mapping[str, QueryBuilder] | None = None
) -> Column:
    """Query of the builder registered for the task, else of the general one."""
    built = general_query(question)
    for name, builder in (builders or {}).items():
        built = F.when(task == name, builder(question)).otherwise(built)
    return built
