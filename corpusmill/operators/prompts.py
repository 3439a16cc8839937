"""Prompt templates and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import fits_broadcast

NO_CONTEXT = "No relevant context found."


def duplicate_templates(templates: DataFrame) -> DataFrame:
    """(task, version) pairs that occur more than once; a template table has none."""
    return templates.groupBy("task", "version").count().filter("count > 1")


def missing_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """(task, prompt_version) pairs of requests without a template."""
    known = templates.select("task", F.col("version").alias("prompt_version"))
    return requests.select("task", "prompt_version").distinct().join(known, ["task", "prompt_version"], "left_anti")


def with_template(requests: DataFrame, templates: DataFrame, needed: Column | None = None) -> DataFrame:
    """Requests with the text of their template; a missing template is an error where ``needed``, by default everywhere."""
    known = templates.select("task", F.col("version").alias("prompt_version"), "template")
    # Few templates serve all requests, whose keys are as few.
    found = requests.join(F.broadcast(known) if fits_broadcast(known) else known, ["task", "prompt_version"], "left")
    complaint = F.concat(F.lit("prompt template not found: "), F.col("task"), F.lit("/"), F.col("prompt_version"))
    error = F.raise_error(complaint).cast("string")
    return found.withColumn("template", F.coalesce("template", error if needed is None else F.when(needed, error)))


def gather_context(candidates: DataFrame, *fields: str) -> DataFrame:
    """One row per query with its candidate list in order; lists are as short as top-k made them."""
    entry = F.struct("rank", *fields)
    return candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("context"))


def prompt_text(template: Column, question: Column, context: Column) -> Column:
    """Template, numbered context blocks and question."""
    blocks = F.transform(
        context,
        lambda c, at: F.concat(
            F.lit("["), (at + 1).cast("string"), F.lit("] "), c["source"], F.lit("\n"), c["content"]
        ),
    )
    joined = F.coalesce(F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.lit(NO_CONTEXT))
    return F.concat(
        template, F.lit("\n\nRetrieved context:\n"), joined, F.lit("\n\nUser question:\n"), question
    )


def render_prompts(requests: DataFrame, candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """``prompt`` for every request, also for those without candidates."""
    context = gather_context(candidates, "source", "content")
    return (
        with_template(requests, templates)
        .join(context, "query_id", "left")
        .withColumn("prompt", prompt_text(F.col("template"), F.col("question"), F.col("context")))
        .drop("context", "template")
    )
