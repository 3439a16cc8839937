"""Term tables of a chunk corpus: what a search reads instead of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bind
from corpusmill.session import fits_broadcast

TOKEN_GAP = r"[^\p{L}\p{N}]+"

#: Term under which the statistics keep the number of chunks and of tokens of the whole corpus.
WHOLE_CORPUS = ""


def tokens(content: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(content), TOKEN_GAP), lambda token: token != "")


def term_counts(found: Column) -> Column:
    """array<struct<term, tf>> by sorting and measuring runs: no shuffle, the chunk stays in its row."""

    def runs(ordered: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda at: (at == 0) | (F.get(ordered, at) != F.get(ordered, at - 1)),
        )

        def measure(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, nth: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(starts, nth + 1), F.size(ordered)) - at).alias("tf"),
                ),
            )

        return bind(opens, measure)

    none = F.array().cast("array<struct<term: string, tf: int>>")
    return F.when(F.size(found) > 0, bind(F.array_sort(found), runs)).otherwise(none)


CHUNK_COLUMNS = ("chunk_id", "task", "article_number", "clause_number")


def analyzed(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its tokens, for searches that read the whole corpus once."""
    return with_filter_columns(chunks).select(*CHUNK_COLUMNS, tokens(F.col("content")).alias("tokens"))


def postings(chunks: DataFrame) -> DataFrame:
    """One row per chunk and term: chunk_id, task, article and clause, dl, term, tf.

    ``dl`` is the number of tokens of the chunk. This is the form that is stored by term.
    """
    counted = analyzed(chunks).select(
        *CHUNK_COLUMNS, F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("_terms")
    )
    return counted.select(*CHUNK_COLUMNS, "dl", F.inline("_terms"))


def with_filter_columns(chunks: DataFrame) -> DataFrame:
    """Article and clause of the metadata as plain columns, where the frame has no such columns yet."""
    if "article_number" in chunks.columns:
        return chunks
    return chunks.withColumn("article_number", F.col("metadata.article_number")).withColumn(
        "clause_number", F.col("metadata.clause_number")
    )


def term_statistics(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, df, n_tokens)``: chunks a term occurs in and their token total, and under
    ``WHOLE_CORPUS`` the same of all chunks.

    ``chunks`` may be ``analyzed`` already, or ``counted_terms``. One pass over the text, with counts added up before the shuffle. ``vocabulary(term)`` limits the
    terms counted: up to a checked size it is shipped and other words are dropped where they are read, beyond it
    sums per word and task are shuffled before it is looked at.
    """
    if "terms" in chunks.columns:
        # Sums per batch are a fraction of the postings.
        from corpusmill.operators.lexical_blocks import term_sums

        seen, n_chunks, n_tokens = term_sums(chunks, WHOLE_CORPUS), F.sum("df"), F.sum("n_tokens")
    else:
        found = F.col("tokens") if "tokens" in chunks.columns else tokens(F.col("content"))
        analyzed = chunks.select(found.alias("_tokens"))
        seen = analyzed.select(
            F.size("_tokens").alias("dl"),
            F.explode(F.array_append(F.array_distinct("_tokens"), F.lit(WHOLE_CORPUS))).alias("term"),
        )
        n_chunks, n_tokens = F.count(F.lit(1)), F.sum("dl").cast("bigint")

    def counted(found: DataFrame) -> DataFrame:
        return found.groupBy("term").agg(n_chunks.alias("df"), n_tokens.alias("n_tokens"))

    if vocabulary is None:
        return counted(seen)
    marker = vocabulary.sparkSession.range(1).select(F.lit(WHOLE_CORPUS).alias("term"))
    wanted = vocabulary.select("term").distinct().union(marker)
    if fits_broadcast(wanted):
        return counted(seen.join(F.broadcast(wanted), "term", "left_semi"))
    return counted(seen).join(wanted, "term", "left_semi")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct words of the corpus."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).distinct()
