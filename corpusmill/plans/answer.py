"""The answer flow for a table of requests: label, retrieve, rerank, prompt, score and price."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.guardrails import evidence_label, scope_label
from corpusmill.functions.lexical_query import QueryBuilder, article_asked
from corpusmill.functions.pricing import request_cost
from corpusmill.functions.quality import (
    answer_relevance, citation_presence, completeness, content_words, groundedness,
)
from corpusmill.functions.routing import fallback_outcome, routing_decision
from corpusmill.operators.evidence import EVIDENCE_DEPTH, with_abstentions
from corpusmill.operators.prompts import gather_context, prompt_text, with_template
from corpusmill.operators.rerank import rerank
from corpusmill.operators.retrieve import RetrievalSettings, attach_payload, retrieve


def prepare_prompts(
    requests: DataFrame, chunks: DataFrame, templates: DataFrame, rules: Column,
    settings: RetrievalSettings = RetrievalSettings(),
    builders: Mapping[str, QueryBuilder] | None = None, pair_score: Column | None = None,
    rerank_keep: int | None = None, **search: object,
) -> DataFrame:
    """Requests with scope, evidence, candidate list, routing decision and prompt.

    Only requests in scope are searched for and need a template; only those with evidence are routed. Others may name
    versions and providers that do not exist. Candidate lists are gathered once per request; evidence,
    prompt and later the scores read the same list.
    """
    scoped = requests.withColumn("scope", scope_label(F.col("question"), F.col("task")))
    searched = scoped.filter("scope.status = 'in_scope'").drop("scope")
    found = attach_payload(retrieve(searched, chunks, settings, builders, **search), chunks)
    ordered = rerank(found, searched, pair_score, rerank_keep)
    context = gather_context(
        ordered.withColumn("article_number", F.col("metadata.article_number")),
        "chunk_id", "source", "content", "article_number", "score", "rerank_score", "reranker_type",
    )
    asked = article_asked(F.col("question"))
    in_top = F.exists(
        F.slice("context", 1, EVIDENCE_DEPTH), lambda c: F.coalesce(c["article_number"] == asked, F.lit(False))
    )
    decision = routing_decision(rules, F.col("task"), F.col("quality_mode"), F.col("prompt_version"))
    in_scope = F.col("scope.status") == "in_scope"
    return (
        with_template(scoped, templates, in_scope)
        .join(context, "query_id", "left")
        .withColumn("evidence", evidence_label(F.col("question"), F.size("context"), in_top))
        .withColumn("routing", F.when(in_scope & (F.col("evidence.status") == "sufficient"), decision))
        .withColumn("prompt", prompt_text(F.col("template"), F.col("question"), F.col("context")))
        .drop("template")
    )


def assemble_responses(prepared: DataFrame, answers: DataFrame) -> DataFrame:
    """One wide row per request.

    ``answers(query_id, attempt, ok, answer, prompt_tokens, completion_tokens, latency_ms,
    provider_reported_cost_usd, provider_generation_id, provider_usage_source)``: attempt 1 is the
    routed model, attempt 2 its fallback. Requests whose model failed without a fallback keep a row
    with ``failed`` set.
    """
    fields = [name for name in answers.columns if name not in ("query_id", "attempt")]

    def attempt(number: int) -> DataFrame:
        taken = answers.filter(F.col("attempt") == number)
        return taken.select("query_id", F.struct(*fields).alias(f"attempt_{number}"))

    outcome = fallback_outcome(F.col("routing"), F.coalesce("attempt_1.ok", F.lit(False)))
    called = (
        prepared.join(attempt(1), "query_id", "left")
        .join(attempt(2), "query_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("reply", F.when(F.col("outcome.fallback_used"), F.col("attempt_2")).otherwise(F.col("attempt_1")))
        .withColumn("answer", F.coalesce("reply.answer", F.lit("")))
        .withColumn("_asked", content_words(F.col("question")))
        .withColumn("_answered", content_words(F.col("answer")))
        .withColumn(
            "_context", content_words(F.array_join(F.transform("context", lambda c: c["content"]), " "))
        )
    )
    has_context = F.coalesce(F.size("context") > 0, F.lit(False))
    context_words = F.coalesce("_context", F.array().cast("array<string>"))
    tokens_in = F.coalesce("reply.prompt_tokens", F.lit(0))
    tokens_out = F.coalesce("reply.completion_tokens", F.lit(0))
    cost = request_cost(F.col("outcome.provider"), F.col("outcome.model"), tokens_in, tokens_out)
    priced = called.withColumn("_cost", cost)
    answered = priced.select(
        "query_id", "question", "task", "quality_mode", "prompt_version", "scope", "evidence", "answer",
        F.col("outcome.provider").alias("provider"),
        F.col("outcome.model").alias("model"),
        F.col("outcome.fallback_used").alias("fallback_used"),
        F.col("routing.fallback_provider").alias("fallback_provider"),
        F.col("routing.fallback_model").alias("fallback_model"),
        F.col("routing.reason").alias("routing_reason"),
        F.col("outcome.note").alias("routing_notes"),
        F.col("outcome.failed").alias("failed"),
        F.coalesce("reply.latency_ms", F.lit(0.0)).alias("latency_ms"),
        tokens_in.alias("prompt_tokens"),
        tokens_out.alias("completion_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        groundedness(F.col("answer"), has_context).alias("groundedness_score"),
        answer_relevance(F.col("_asked"), F.col("_answered")).alias("answer_relevance_score"),
        citation_presence(F.col("answer")).alias("citation_score"),
        completeness(F.col("answer"), F.col("_answered"), context_words).alias("completeness_score"),
        F.col("_cost.total_cost_usd").alias("estimated_cost_usd"),
        F.col("_cost.input_cost_usd").alias("input_cost_usd"),
        F.col("_cost.output_cost_usd").alias("output_cost_usd"),
        F.col("_cost.pricing_source").alias("pricing_source"),
        F.col("_cost.cost_is_estimated").alias("cost_is_estimated"),
        F.col("reply.provider_reported_cost_usd").alias("provider_reported_cost_usd"),
        F.col("reply.provider_generation_id").alias("provider_generation_id"),
        F.col("reply.provider_usage_source").alias("provider_usage_source"),
        F.transform("context", lambda c: c["chunk_id"]).alias("retrieved_chunk_ids"),
    )
    responses = with_abstentions(answered)
    return responses.withColumn("failed", F.col("failed") & ~F.col("abstained")).drop("scope", "evidence")


