"""Answer scores between 0 and 5 from words of question, answer and context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import round_exact, strip

# Words that carry no content.
FUNCTION_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "what", "with",
)

# Traces of a citation.
CITATION_PATTERNS = (r"\barticle\s+\d+\b", r"\bchunk\s+\d+\b", r"\[\d+\]", r"\bclause\s+\d+\b")


def content_words(text: Column) -> Column:
    """Distinct ASCII words of more than two characters that are no function words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.array_distinct(
        F.filter(found, lambda word: (F.length(word) > 2) & ~word.isin(*FUNCTION_WORDS))
    )


def clamp_score(value: Column) -> Column:
    """Into 0..5, two decimals."""
    return round_exact(F.greatest(F.lit(0.0), F.least(F.lit(5.0), value)), 2)


def _share(part: Column, whole: Column | int) -> Column:
    return F.least(part / whole, F.lit(1.0))


def answer_relevance(question_words: Column, answer_words: Column) -> Column:
    """Overlap of question and answer words plus a bonus for length."""
    overlap = F.size(F.array_intersect(question_words, answer_words)) / F.nullif(
        F.size(question_words), F.lit(0)
    )
    score = overlap * 4.0 + _share(F.size(answer_words), 40)
    return F.when(F.size(question_words) == 0, F.lit(0.0)).otherwise(clamp_score(score))


def citation_presence(answer: Column) -> Column:
    """1.5 points for each kind of citation found."""
    found = sum((answer.rlike(f"(?iU){p}").cast("int") for p in CITATION_PATTERNS), F.lit(0))
    return clamp_score(found * 1.5)


def completeness(answer: Column, answer_words: Column, context_words: Column) -> Column:
    """How much of the context the answer takes up, plus a bonus for length."""
    context_size = F.size(context_words)
    coverage = F.size(F.array_intersect(answer_words, context_words)) / F.greatest(
        F.least(context_size, F.lit(30)), F.lit(1)
    )
    with_context = clamp_score(coverage * 4.0 + _share(F.size(answer_words), 50))
    without_context = clamp_score(_share(F.size(answer_words), 20) * 5.0)
    return (
        F.when(strip(answer) == "", F.lit(0.0))
        .when(context_size == 0, without_context)
        .otherwise(with_context)
    )


def groundedness(answer: Column, has_context: Column) -> Column:
    """3 for an answer on context, 1 when there is none although context exists, or neither exists."""
    has_answer = answer != ""
    return (
        F.when(has_context & has_answer, 3.0)
        .when(has_context | ~has_answer, 1.0)
        .otherwise(0.0)
    )
