"""Schemas of the tables and JSON records the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from corpusmill.functions.legal import CHUNK_METADATA_TYPE
from corpusmill.functions.trace import TRACE_TYPE

PROMPTS = "task string, version string, template string, description string, is_active boolean"

DOCUMENTS = (
    "document_id bigint, task string, title string, source_path string, document_type string, "
    "page_count int, source_file string, "
    "embedding_config struct<provider: string, model: string, dimensions: int>"
)

CHUNKS = (
    "chunk_id string, document_id bigint, task string, source_path string, title string, "
    f"chunk_index int, content string, token_count int, metadata {CHUNK_METADATA_TYPE}, "
    "embedding array<float>"
)

#: One retrieved chunk of one request; ``rank`` is its place in the list, from 1.
CANDIDATES = (
    "query_id string, rank int, chunk_id string, score double, dense_score double, "
    "lexical_score double, fusion_score double, retrieval_sources array<string>"
)

#: One request of a batch.
REQUESTS = (
    "query_id string, question string, task string, quality_mode string, prompt_version string, "
    "retrieval_mode string, lexical_backend string, top_k int, reranker_type string"
)

DATASET = (
    "question string, relevant_chunk_ids array<string>, gold_answer string, "
    "metadata map<string,string>"
)

REPORT = (
    "results array<struct<question: string, relevant_chunk_ids: array<string>, "
    "retrieved_ids: array<string>, metrics: map<string,double>>>, "
    "aggregate map<string,double>, n_samples bigint, k_values array<int>, config map<string,string>"
)

QUESTION_LIST = "question string, task string, expected_topics array<string>"

_CHUNK_REF = (
    "struct<chunk_id: string, source: string, content: string, score: double, rerank_score: double, "
    "title: string, chunk_index: int, metadata: map<string,string>>"
)

_STEP_OUTPUT = (
    "struct<retrieval_mode: string, retrieval_count: int, reranker_type: string, answer: string, "
    "provider: string, model: string, estimated_cost_usd: double, pricing_source: string, "
    "provider_reported_cost_usd: double, provider_generation_id: string, "
    "provider_usage_source: string, subject: string, body: string, "
    f"retrieved_chunks: array<{_CHUNK_REF}>>"
)

STEPS = (
    "array<struct<step_id: string, step_type: string, title: string, capability_name: string, "
    f"status: string, latency_ms: double, output: {_STEP_OUTPUT}, "
    "checkpoint: struct<decision: string, reason: string, metrics: map<string,double>>, error: string>>"
)

_REQUEST = (
    "struct<question: string, task: string, quality_mode: string, prompt_version: string, "
    "retrieval_mode: string, top_k: int, reranker_type: string, task_type: string, "
    "instruction: string, recipient_email: string>"
)

EVALUATION = (
    "struct<groundedness_score: double, answer_relevance_score: double, citation_score: double, "
    "completeness_score: double, estimated_cost_usd: double, input_cost_usd: double, "
    "output_cost_usd: double, pricing_source: string, cost_is_estimated: boolean, "
    "provider_reported_cost_usd: double, provider_generation_id: string, "
    "provider_usage_source: string, routing_notes: string>"
)

_RESPONSE = (
    "struct<answer: string, task: string, quality_mode: string, prompt_version: string, "
    f"model_name: string, retrieved_chunks: array<{_CHUNK_REF}>, latency_ms: double, "
    "token_usage: struct<prompt_tokens: int, completion_tokens: int, total_tokens: int>, "
    "routing: struct<selected_provider: string, selected_model: string, fallback_used: boolean, "
    "fallback_provider: string, fallback_model: string, reason: string>, "
    "reranking: struct<reranker_type: string, reranker_model: string, reranker_top_k: int>, "
    "guardrails: struct<scope_status: string, evidence_status: string, abstained: boolean, reason: string>, "
    f"trace: struct<events: {TRACE_TYPE}>, evaluation: {EVALUATION}, "
    "run_id: string, task_type: string, status: string, created_at: timestamp, "
    f"completed_at: timestamp, steps: {STEPS}, "
    "final_output: struct<answer: string, answer_metadata: struct<provider: string, model: string, "
    "fallback_used: boolean, prompt_tokens: int, completion_tokens: int, total_tokens: int>, "
    f"retrieved_chunks: array<{_CHUNK_REF}>>, stop_reason: string>"
)

#: One logged request or agent run; the agent columns stay empty for requests.
QUERY_LOGS = (
    "query_log_id string, request_kind string, task string, quality_mode string, prompt_version string, "
    "agent_run_id string, agent_task_type string, instruction string, agent_status string, "
    "agent_stop_reason string, agent_step_count int, agent_report_json string, selected_provider string, "
    "model_name string, reranker_type string, reranker_model string, reranker_top_k int, "
    "fallback_used boolean, fallback_provider string, fallback_model string, routing_reason string, "
    "question string, answer string, latency_ms double, prompt_tokens int, completion_tokens int, "
    f"total_tokens int, retrieved_chunk_ids array<string>, trace_json {TRACE_TYPE}, status string, "
    "created_at timestamp"
)

#: One line of the request log: a query or an agent run, told apart by ``request_kind``.
LOG_RECORD = f"timestamp timestamp, request_kind string, request {_REQUEST}, response {_RESPONSE}"

AGENT_REPORT = _RESPONSE
