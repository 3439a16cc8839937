"""Guardrails, routing, prices, prompts, scores and the whole answer flow on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.guardrails import NO_EVIDENCE_ANSWER, OUT_OF_SCOPE_ANSWER, scope_label
from corpusmill.functions.pricing import display_cost, request_cost
from corpusmill.functions.quality import (
    answer_relevance, citation_presence, completeness, content_words, groundedness,
)
from corpusmill.functions.routing import fallback_outcome, parse_rules, routing_decision, rule_table
from corpusmill.operators.evidence import label_evidence
from corpusmill.operators.experiment import experiment_grid
from corpusmill.operators.prompts import duplicate_templates, missing_templates, render_prompts
from corpusmill.operators.retrieve import RetrievalSettings
from corpusmill.plans.answer import assemble_responses, prepare_prompts


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "question,task,status,reason",
    [
        ("What is the weather in Amsterdam?", "legal_qa", "out_of_scope", "question matches off-topic cues for legal_qa"),
        ("What is the weather in Amsterdam?", "other", "in_scope", "no task-specific scope policy configured"),
        ("Is there a flaw?", "legal_qa", "in_scope", "question matches legal_qa domain cues"),
        ("search \n  ENGINE size", "legal_qa", "in_scope", "question matches legal_qa domain cues"),
        ("Tell me more", "legal_qa", "out_of_scope", "question does not look grounded in the ingested legal corpus"),
    ],
)
def test_scope(spark, question, task, status, reason):
    assert tuple(one(spark, scope_label(F.lit(question), F.lit(task)))) == (status, reason)


def test_evidence(spark):
    asked = spark.createDataFrame(
        [("none", "Article 12?"), ("open", "what?"), ("hit", "article 12"), ("late", "Article 12"), ("miss", "Article 99")],
        "query_id string, question string",
    )
    chunks = [("open", 1, None), ("hit", 1, None), ("hit", 3, "12"), ("late", 1, "1"), ("late", 2, "2"), ("late", 3, "3"), ("late", 4, "12"), ("miss", 1, "12")]
    candidates = spark.createDataFrame(chunks, "query_id string, rank int, article_number string")
    got = {r.query_id: tuple(r.evidence) for r in label_evidence(asked, candidates).collect()}
    assert got == {
        "none": ("insufficient", "no chunks were retrieved"),
        "open": ("sufficient", "retrieval returned candidate evidence"),
        "hit": ("sufficient", "top retrieved chunks match the requested article"),
        "late": ("insufficient", "top retrieved chunks do not match requested article 12"),
        "miss": ("insufficient", "top retrieved chunks do not match requested article 99"),
    }


RULES = '{"legal_qa": {"provider": " OpenAI", "model": "gpt-4.1", "extra": 1}, "legal_qa.cheap": {"provider": "openrouter", "fallback_provider": "openai"}, "plain": {}}'


def route(spark, task, mode, rules=RULES):
    return one(spark, routing_decision(rule_table(parse_rules(rules)), F.lit(task), F.lit(mode), F.lit("v1")))


def test_routing(spark):
    cheap = route(spark, "legal_qa", "cheap")
    assert tuple(cheap) == ("openrouter", "openai/gpt-4.1-mini", "openai", "gpt-4.1-mini", "task override for 'legal_qa' in quality mode 'cheap'")
    assert tuple(route(spark, "legal_qa", "default"))[:4] == ("openai", "gpt-4.1", None, None)
    default = ("openai", "gpt-4.1-mini", None, None, "default provider for prompt version 'v1' in quality mode 'x'")
    assert tuple(route(spark, "other", "x")) == default
    assert tuple(route(spark, "plain", "x")) == default
    with pytest.raises(Exception, match="unsupported routed provider"):
        route(spark, "t", "x", '{"t": {"provider": "acme", "model": "m"}}')


@pytest.mark.parametrize("text", ["{", "[]", '{"a": 1}'])
def test_bad_rules(text):
    with pytest.raises(ValueError):
        parse_rules(text)


def test_no_rules(spark):
    assert parse_rules("  ") == {}
    assert route(spark, "t", "x", "").provider == "openai"


def test_fallback(spark):
    def outcome(task, mode, ok):
        decision = routing_decision(rule_table(parse_rules(RULES)), F.lit(task), F.lit(mode), F.lit("v1"))
        return tuple(one(spark, fallback_outcome(decision, F.lit(ok))))

    assert outcome("legal_qa", "cheap", True) == ("openrouter", "openai/gpt-4.1-mini", False, False, None)
    assert outcome("legal_qa", "cheap", False) == (
        "openai", "gpt-4.1-mini", True, False, "Fallback used: openrouter/openai/gpt-4.1-mini -> openai/gpt-4.1-mini",
    )
    assert outcome("other", "x", False)[2:] == (False, True, None)


def test_cost(spark):
    def cost(provider, model, tokens_in=1000, tokens_out=500):
        return tuple(one(spark, request_cost(F.lit(provider), F.lit(model).cast("string"), F.lit(tokens_in), F.lit(tokens_out))))

    assert cost("openai", "gpt-4.1-mini") == (0.0024, 0.0008, 0.0016, "OpenAI pricing (gpt-4.1-mini)", False)
    assert cost("openrouter", "openai/gpt-4.1")[4] is True
    assert cost("openai", None) == (0.0, 0.0, 0.0, "No model selected", True)
    assert cost("acme", "m") == (0.0, 0.0, 0.0, "Unknown price card for acme/m", True)
    assert one(spark, display_cost(F.lit(None).cast("double"), F.lit(0.5))) == 0.5
    assert one(spark, display_cost(F.lit(0.0), F.lit(0.5))) == 0.0


def test_scores(spark):
    def words(text):
        return content_words(F.lit(text))

    assert sorted(one(spark, words("The Größe of AB abc ABC x1y what 123"))) == ["123", "abc", "x1y"]
    assert one(spark, answer_relevance(words("alpha beta"), words("alpha gamma delta epsilon"))) == 2.1
    assert one(spark, answer_relevance(words("what is it"), words("alpha"))) == 0.0
    assert one(spark, citation_presence(F.lit("See Article 5 [1]"))) == 3.0
    assert one(spark, citation_presence(F.lit("article 5, Chunk 1, [2], CLAUSE 3"))) == 5.0
    full, half = words("alpha beta"), words("alpha beta gamma delta")
    assert one(spark, completeness(F.lit("alpha beta"), full, half)) == round(2 / 4 * 4 + 2 / 50, 2)
    assert one(spark, completeness(F.lit("alpha beta"), full, words(""))) == 0.5
    assert one(spark, completeness(F.lit(" \n"), words(""), half)) == 0.0
    cases = {("a", True): 3.0, ("", True): 1.0, ("a", False): 0.0, ("", False): 1.0}
    assert {k: one(spark, groundedness(F.lit(k[0]), F.lit(k[1]))) for k in cases} == cases


def test_prompts(spark):
    templates = spark.createDataFrame([("t", "v1", "Be exact.")], "task string, version string, template string")
    asked = spark.createDataFrame([("a", "Q?", "t", "v1"), ("b", "R?", "t", "v1")], "query_id string, question string, task string, prompt_version string")
    found = spark.createDataFrame([("a", 2, "s2", "two"), ("a", 1, "s1", "one")], "query_id string, rank int, source string, content string")
    got = {r.query_id: r.prompt for r in render_prompts(asked, found, templates).collect()}
    assert got["a"] == "Be exact.\n\nRetrieved context:\n[1] s1\none\n\n[2] s2\ntwo\n\nUser question:\nQ?"
    assert got["b"] == "Be exact.\n\nRetrieved context:\nNo relevant context found.\n\nUser question:\nR?"
    unknown = asked.withColumn("prompt_version", F.lit("v9"))
    assert [tuple(r) for r in missing_templates(unknown, templates).collect()] == [("t", "v9")]
    with pytest.raises(Exception, match="prompt template not found"):
        render_prompts(unknown, found, templates).collect()
    assert duplicate_templates(templates.union(templates)).count() == 1


def test_grid(spark):
    asked = spark.createDataFrame([("q1",), ("q2",)], "question string")
    grid = experiment_grid(asked, {"reranker_type": ["a", "b"], "quality_mode": ["x", "y", "z"]})
    assert grid.count() == 12 and grid.distinct().count() == 12


def test_answer_flow(spark):
    meta = "metadata struct<article_number: string, clause_number: array<bigint>, article_title: string>"
    chunks = spark.createDataFrame(
        [("d::chunk::0", "d", "D", 0, "legal_qa", "hosting providers remove illegal content", ("6", [1], "T")),
         ("d::chunk::1", "d", "D", 1, "legal_qa", "trusted flagger notice", ("22", [2], "T"))],
        f"chunk_id string, source_path string, title string, chunk_index int, task string, content string, {meta}",
    )
    asked = spark.createDataFrame(
        [("ok", "What must hosting providers do?"), ("weather", "How is the weather?"), ("miss", "Does Article 99 name hosting?"), ("fail", "Which notice?")],
        "query_id string, question string",
    ).withColumns({"task": F.lit("legal_qa"), "quality_mode": F.when(F.col("query_id") == "ok", "cheap").otherwise("x"), "prompt_version": F.lit("v1")})
    templates = spark.createDataFrame([("legal_qa", "v1", "T")], "task string, version string, template string")
    answers = spark.createDataFrame(
        [("ok", 1, False, "", 0, 0), ("ok", 2, True, "Hosting providers remove content, see Article 6 [1].", 1000, 500), ("fail", 1, False, "", 0, 0)],
        "query_id string, attempt int, ok boolean, answer string, prompt_tokens int, completion_tokens int",
    ).withColumns({"latency_ms": F.lit(5.0), "provider_reported_cost_usd": F.lit(None).cast("double"),
                   "provider_generation_id": F.lit(None).cast("string"), "provider_usage_source": F.lit(None).cast("string")})
    settings = RetrievalSettings(mode="lexical", lexical_backend="bm25")
    prepared = prepare_prompts(asked, chunks, templates, rule_table(parse_rules(RULES)), settings, modes=("lexical",), backends=("bm25",))
    got = {r.query_id: r for r in assemble_responses(prepared, answers).collect()}
    ok = got["ok"]
    assert (ok.provider, ok.model, ok.fallback_used, ok.abstained, ok.failed) == ("openai", "gpt-4.1-mini", True, False, False)
    assert (ok.groundedness_score, ok.citation_score, ok.estimated_cost_usd, ok.total_tokens) == (3.0, 3.0, 0.0024, 1500)
    assert ok.retrieved_chunk_ids == ["d::chunk::0"] and ok.evidence_status == "sufficient"
    assert (got["weather"].answer, got["weather"].provider, got["weather"].evidence_status) == (OUT_OF_SCOPE_ANSWER, "guardrail", None)
    miss = got["miss"]
    assert (miss.answer, miss.abstained, miss.groundedness_score, miss.routing_notes) == (
        NO_EVIDENCE_ANSWER, True, 0.0, "no chunks were retrieved",
    )
    assert got["fail"].failed and not got["fail"].abstained
