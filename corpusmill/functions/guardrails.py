"""Scope and evidence labels of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.lexical_query import article_asked
from corpusmill.functions.text import collapse

# Phrases that place a question inside the legal corpus.
DOMAIN_TERMS = (
    "article", "clause", "paragraph", "regulation", "law", "legal", "digital services act", "dsa", "provider",
    "platform", "search engine", "commission", "coordinator", "coordinators", "board", "fine", "fines",
    "risk assessment", "notice", "hosting", "intermediary service", "trusted flagger", "statement of reasons",
    "terms and conditions", "illegal content",
)

# Phrases of other subjects.
OFF_TOPIC_TERMS = (
    "weather", "temperature", "recipe", "restaurant", "flight", "hotel", "movie", "song", "lyrics",
    "python", "javascript", "debug", "algorithm", "sql query", "travel plan", "birthday",
)

SCOPED_TASK = "legal_qa"

# Answers given instead of a model answer.
OUT_OF_SCOPE_ANSWER = (
    "This assistant only answers questions grounded in the ingested legal document. "
    "Ask about the Digital Services Act or a specific article, clause, or legal concept in the corpus."
)
NO_EVIDENCE_ANSWER = (
    "I can't answer that confidently from the retrieved sections of this legal document. "
    "Try naming the relevant article, clause, or concept more explicitly."
)


def _mentions(text: Column, terms: tuple[str, ...]) -> Column:
    return text.rlike("|".join(terms))


def scope_label(question: Column, task: Column) -> Column:
    """struct<status, reason>; terms count wherever they occur, also inside longer words."""
    plain = collapse(F.lower(question))
    on_topic = _mentions(plain, DOMAIN_TERMS) | article_asked(question).isNotNull()

    def label(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(task != SCOPED_TASK, label("in_scope", "no task-specific scope policy configured"))
        .when(on_topic, label("in_scope", "question matches legal_qa domain cues"))
        .when(
            _mentions(plain, OFF_TOPIC_TERMS),
            label("out_of_scope", "question matches off-topic cues for legal_qa"),
        )
        .otherwise(
            label("out_of_scope", "question does not look grounded in the ingested legal corpus")
        )
    )


def evidence_label(question: Column, n_chunks: Column, article_in_top: Column) -> Column:
    """struct<status, reason> from the number of chunks and whether a top chunk is of the asked article."""
    asked = article_asked(question)

    def label(status: str, reason: Column | str) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), text.alias("reason"))

    missing = F.concat(F.lit("top retrieved chunks do not match requested article "), asked)
    return (
        F.when(F.coalesce(n_chunks, F.lit(0)) == 0, label("insufficient", "no chunks were retrieved"))
        .when(asked.isNull(), label("sufficient", "retrieval returned candidate evidence"))
        .when(article_in_top, label("sufficient", "top retrieved chunks match the requested article"))
        .otherwise(label("insufficient", missing))
    )
