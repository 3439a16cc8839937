"""Queries of request enrichment: guardrails, routing, prompts, scores, costs and whole responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.guardrails import (
    DOMAIN_TERMS, NO_EVIDENCE_ANSWER, OFF_TOPIC_TERMS, OUT_OF_SCOPE_ANSWER, scope_label,
)
from corpusmill.functions.pricing import display_cost, request_cost
from corpusmill.functions.quality import (
    answer_relevance, citation_presence, completeness, content_words, groundedness,
)
from corpusmill.functions.routing import fallback_outcome, parse_rules, routing_decision, rule_table
from corpusmill.operators.evidence import EVIDENCE_DEPTH, abstention_answer, abstention_reason, label_evidence
from corpusmill.operators.experiment import experiment_grid
from corpusmill.operators.prompts import gather_context, render_prompts
from corpusmill.operators.retrieve import RetrievalSettings
from corpusmill.plans.answer import assemble_responses, prepare_prompts
from corpusmill.plans.catalog import inputs
from corpusmill.plans.catalog.corpus import stored_legal_chunks
from corpusmill.plans.catalog.inputs import LEGAL_CHUNKS_SQL
from corpusmill.plans.catalog.retrieval import BM25_SQL, postings_sql, terms_sql

QUOTE = "'"


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(QUOTE + word.replace(QUOTE, QUOTE * 2) + QUOTE for word in words) + "]"


def exact_sql(value: str, digits: int) -> str:
    """Rounding of the exact binary value."""
    return f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn behind it, worded as a question to some task."""
    turns = inputs.table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("said"))
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    question = (
        F.when(kind == 0, F.col("said"))
        .when(kind == 1, F.concat("said", F.lit(" Which rule of Article 3 applies?")))
        .when(kind == 2, F.concat(F.lit("What is the weather?\n "), "said"))
        .when(kind == 3, F.concat("said", F.lit("  Which Fines does clause 2 set for a search\n engine?")))
        .otherwise(F.concat(F.lit("Article 4 and article 1: "), "said"))
    )
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        "conv_id", "turn", question.alias("question"),
        F.when(F.col("conv_id") % 3 == 0, "support").otherwise("legal_qa").alias("task"),
        F.coalesce("answer", F.lit("")).alias("answer"),
    )


def earlier_turns(spark: SparkSession, folder: str, depth: int | None = None) -> DataFrame:
    """The turns before a user turn as its candidate list, nearest first: all of them, or the nearest ``depth``.

    Evidence looks at the nearest ones only; those are found by their numbers. A prompt holds its whole context, so its length grows
    with the conversation.
    """
    turns = inputs.table(spark, folder, "conversations")
    earlier = turns.select("conv_id", F.col("turn").alias("own_turn"), F.col("text").alias("content"))
    users = turns.filter("role = 'user'").select("conv_id", "turn")
    if depth is None:
        found = earlier.join(users, "conv_id").filter("own_turn < turn").withColumn("place", (F.col("turn") - F.col("own_turn")).cast("int"))
    else:
        places = F.explode(F.sequence(F.lit(1), F.lit(depth)))
        found = earlier.withColumn("place", places).withColumn("turn", F.col("own_turn") + F.col("place")).join(users, ["conv_id", "turn"])
    return found.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("place").alias("rank"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source"),
        "content",
        F.nullif(((F.col("conv_id") + F.col("own_turn")) % 5).cast("string"), F.lit("0")).alias("article_number"),
    )


EXCHANGES_SQL = """
exchanges AS (
  SELECT u.conv_id || ':' || u.turn AS query_id, u.conv_id, u.turn,
    CASE (u.conv_id + u.turn) % 5
      WHEN 0 THEN u.text
      WHEN 1 THEN u.text || ' Which rule of Article 3 applies?'
      WHEN 2 THEN 'What is the weather?' || chr(10) || ' ' || u.text
      WHEN 3 THEN u.text || '  Which Fines does clause 2 set for a search' || chr(10) || ' engine?'
      ELSE 'Article 4 and article 1: ' || u.text END AS question,
    CASE WHEN u.conv_id % 3 = 0 THEN 'support' ELSE 'legal_qa' END AS task,
    coalesce(a.text, '') AS answer
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
earlier AS (
  SELECT u.conv_id || ':' || u.turn AS query_id, u.turn - c.turn AS rank, 'conv/' || c.conv_id AS source,
    c.text AS content, nullif(CAST((c.conv_id + c.turn) % 5 AS VARCHAR), '0') AS article_number
  FROM conversations u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn < u.turn
  WHERE u.role = 'user'
)"""


def scope_sql(source: str, name: str = "scoped") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN task <> 'legal_qa' THEN 'in_scope' WHEN on_topic THEN 'in_scope' ELSE 'out_of_scope' END AS scope_status,
    CASE WHEN task <> 'legal_qa' THEN 'no task-specific scope policy configured'
      WHEN on_topic THEN 'question matches legal_qa domain cues'
      WHEN off_topic THEN 'question matches off-topic cues for legal_qa'
      ELSE 'question does not look grounded in the ingested legal corpus' END AS scope_reason
  FROM (
    SELECT *, nullif(regexp_extract(question, '(?i)\\barticle\\s+(\\d+)\\b', 1), '') AS asked,
      len(list_filter({sql_list(DOMAIN_TERMS)}, lambda t: contains(regexp_replace(lower(question), '\\s+', ' ', 'g'), t))) > 0
        OR regexp_matches(question, '(?i)\\barticle\\s+(\\d+)\\b') AS on_topic,
      len(list_filter({sql_list(OFF_TOPIC_TERMS)}, lambda t: contains(regexp_replace(lower(question), '\\s+', ' ', 'g'), t))) > 0 AS off_topic
    FROM {source})
)"""


EVIDENCE_SQL = """
CASE WHEN n_chunks = 0 OR n_chunks IS NULL THEN 'insufficient' WHEN asked IS NULL THEN 'sufficient'
  WHEN in_top THEN 'sufficient' ELSE 'insufficient' END AS evidence_status,
CASE WHEN n_chunks = 0 OR n_chunks IS NULL THEN 'no chunks were retrieved' WHEN asked IS NULL THEN 'retrieval returned candidate evidence'
  WHEN in_top THEN 'top retrieved chunks match the requested article'
  ELSE 'top retrieved chunks do not match requested article ' || asked END AS evidence_reason"""


def scope_labels(spark: SparkSession, folder: str) -> DataFrame:
    asked = exchanges(spark, folder).withColumn("scope", scope_label(F.col("question"), F.col("task")))
    return asked.select("query_id", F.col("scope.status").alias("scope_status"), F.col("scope.reason").alias("scope_reason"))


SCOPE_LABELS = f"""WITH {EXCHANGES_SQL},{scope_sql("exchanges")}
SELECT query_id, scope_status, scope_reason FROM scoped"""


def evidence_labels(spark: SparkSession, folder: str) -> DataFrame:
    labelled = label_evidence(exchanges(spark, folder).select("query_id", "question"), earlier_turns(spark, folder, EVIDENCE_DEPTH))
    return labelled.select("query_id", F.col("evidence.status").alias("evidence_status"), F.col("evidence.reason").alias("evidence_reason"))


EVIDENCE_LABELS = f"""WITH {EXCHANGES_SQL},{scope_sql("exchanges")},
seen AS (
  SELECT s.query_id, any_value(s.asked) AS asked, count(e.rank) AS n_chunks,
    coalesce(bool_or(e.article_number = s.asked), false) AS in_top
  FROM scoped s LEFT JOIN earlier e ON e.query_id = s.query_id AND e.rank <= 3 GROUP BY 1
)
SELECT query_id, {EVIDENCE_SQL} FROM seen"""

#: A rule that no request which goes on may meet.
UNSUPPORTED_RULE = {"legal_qa.unsupported": {"provider": "no such provider"}}

RULES_JSON = """{"legal_qa": {"provider": "OpenAI ", "model": "gpt-4.1", "note": "ignored"},
 "legal_qa.view": {"provider": "openrouter", "fallback_provider": " OPENAI"},
 "legal_qa.error": {},
 "summarize": {"model": " custom-model ", "fallback_provider": "openrouter", "fallback_model": "openai/gpt-4.1"}}"""


def routed_events(spark: SparkSession, folder: str) -> DataFrame:
    task = F.when(F.col("user_id") % 3 == 0, "legal_qa").when(F.col("user_id") % 3 == 1, "summarize").otherwise("other")
    routing = routing_decision(rule_table(parse_rules(RULES_JSON)), F.col("task"), F.col("event_type"), F.lit("v1"))
    return inputs.table(spark, folder, "events").withColumn("task", task).withColumn("routing", routing)


ROUTED_SQL = """
routed AS (
  SELECT *,
    CASE WHEN task = 'legal_qa' AND event_type = 'view' THEN 'openrouter' ELSE 'openai' END AS provider,
    CASE WHEN task = 'legal_qa' AND event_type = 'view' THEN 'openai/gpt-4.1-mini'
      WHEN task = 'legal_qa' AND event_type <> 'error' THEN 'gpt-4.1'
      WHEN task = 'summarize' THEN 'custom-model' ELSE 'gpt-4.1-mini' END AS model,
    CASE WHEN task = 'legal_qa' AND event_type = 'view' THEN 'openai' WHEN task = 'summarize' THEN 'openrouter' END AS fallback_provider,
    CASE WHEN task = 'legal_qa' AND event_type = 'view' THEN 'gpt-4.1-mini' WHEN task = 'summarize' THEN 'openai/gpt-4.1' END AS fallback_model,
    CASE WHEN task = 'other' OR (task = 'legal_qa' AND event_type = 'error')
      THEN 'default provider for prompt version ''v1'' in quality mode ''' || event_type || ''''
      ELSE 'task override for ''' || task || ''' in quality mode ''' || event_type || '''' END AS reason
  FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'legal_qa' WHEN 1 THEN 'summarize' ELSE 'other' END AS task FROM events)
)"""


def routing_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return routed_events(spark, folder).select("event_id", "routing.*")


ROUTING_DECISIONS = f"""WITH {ROUTED_SQL}
SELECT event_id, provider, model, fallback_provider, fallback_model, reason FROM routed"""


def fallback_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of 20 or more units fail."""
    outcome = fallback_outcome(F.col("routing"), F.col("value") < 20)
    return routed_events(spark, folder).select("event_id", outcome.alias("o")).select("event_id", "o.*")


FALLBACK_OUTCOME = f"""WITH {ROUTED_SQL}
SELECT event_id,
  CASE WHEN value >= 20 AND fallback_provider IS NOT NULL THEN fallback_provider ELSE provider END AS provider,
  CASE WHEN value >= 20 AND fallback_provider IS NOT NULL THEN fallback_model ELSE model END AS model,
  value >= 20 AND fallback_provider IS NOT NULL AS fallback_used,
  value >= 20 AND fallback_provider IS NULL AS failed,
  CASE WHEN value >= 20 AND fallback_provider IS NOT NULL THEN 'Fallback used: ' || provider || '/' || model
    || ' -> ' || fallback_provider || '/' || fallback_model END AS note
FROM routed"""


def templates(spark: SparkSession) -> DataFrame:
    rows = [(task, version, f"Template {version} of {task}.") for task in ("legal_qa", "support") for version in ("v1", "v2")]
    return spark.createDataFrame(rows, "task string, version string, template string")


def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    asked = exchanges(spark, folder).select(
        "query_id", "question", "task", F.when(F.col("turn") > 2, "v2").otherwise("v1").alias("prompt_version")
    )
    rendered = render_prompts(asked, earlier_turns(spark, folder), templates(spark))
    return rendered.select("query_id", "prompt")


PROMPT_ASSEMBLY = f"""WITH {EXCHANGES_SQL}
SELECT x.query_id, 'Template ' || CASE WHEN any_value(turn) > 2 THEN 'v2' ELSE 'v1' END || ' of ' || any_value(task) || '.'
  || chr(10) || chr(10) || 'Retrieved context:' || chr(10)
  || coalesce(string_agg('[' || rank || '] ' || source || chr(10) || content, chr(10) || chr(10) ORDER BY rank), 'No relevant context found.')
  || chr(10) || chr(10) || 'User question:' || chr(10) || any_value(question) AS prompt
FROM exchanges x LEFT JOIN earlier e ON e.query_id = x.query_id GROUP BY x.query_id"""


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return inputs.table(spark, folder, "events").select(
        "event_id", "value", "user_id",
        F.when(kind.isin("view", "click"), "openai").otherwise("openrouter").alias("provider"),
        F.when(kind == "view", "gpt-4.1-mini").when(kind == "click", "gpt-4.1").when(kind == "purchase", "openai/gpt-4.1-mini")
        .when(kind == "signup", "unlisted").alias("model"),
        (F.get_json_object("props", "$.k").cast("int") * 37).alias("prompt_tokens"),
        F.col("user_id").cast("int").alias("completion_tokens"),
    )


PRICED_SQL = f"""
priced AS (
  SELECT *,
    CASE WHEN event_type IN ('view', 'click') THEN 'openai' ELSE 'openrouter' END AS provider,
    CASE event_type WHEN 'view' THEN 'gpt-4.1-mini' WHEN 'click' THEN 'gpt-4.1' WHEN 'purchase' THEN 'openai/gpt-4.1-mini'
      WHEN 'signup' THEN 'unlisted' END AS model,
    CAST(regexp_extract(props, '\\d+') AS INT) * 37 AS prompt_tokens
  FROM events
),
costed AS (
  SELECT *, {exact_sql("coalesce(spent_in + spent_out, 0)", 6)} AS total_cost_usd,
    {exact_sql("coalesce(spent_in, 0)", 6)} AS input_cost_usd, {exact_sql("coalesce(spent_out, 0)", 6)} AS output_cost_usd
  FROM (
    SELECT *,
      prompt_tokens::DOUBLE / 1000000 * CASE event_type WHEN 'click' THEN 3.0::DOUBLE WHEN 'view' THEN 0.8::DOUBLE WHEN 'purchase' THEN 0.8::DOUBLE END AS spent_in,
      user_id::DOUBLE / 1000000 * CASE event_type WHEN 'click' THEN 12.0::DOUBLE WHEN 'view' THEN 3.2::DOUBLE WHEN 'purchase' THEN 3.2::DOUBLE END AS spent_out
    FROM priced)
)"""


def request_costs(spark: SparkSession, folder: str) -> DataFrame:
    cost = request_cost(F.col("provider"), F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return _priced(spark, folder).select("event_id", cost.alias("c")).select("event_id", "c.*")


REQUEST_COST = f"""WITH {PRICED_SQL}
SELECT event_id, total_cost_usd, input_cost_usd, output_cost_usd,
  CASE event_type WHEN 'view' THEN 'OpenAI pricing (gpt-4.1-mini)' WHEN 'click' THEN 'OpenAI pricing (gpt-4.1)'
    WHEN 'purchase' THEN 'OpenRouter passthrough pricing using OpenAI gpt-4.1-mini rates'
    WHEN 'signup' THEN 'Unknown price card for openrouter/unlisted' ELSE 'No model selected' END AS pricing_source,
  event_type NOT IN ('view', 'click') AS cost_is_estimated
FROM costed"""


def display_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Every third request has a cost reported by the provider."""
    cost = request_cost(F.col("provider"), F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    reported = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return _priced(spark, folder).select("event_id", display_cost(reported, cost["total_cost_usd"]).alias("display_cost_usd"))


DISPLAY_COST = f"""WITH {PRICED_SQL}
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE total_cost_usd END AS display_cost_usd FROM costed"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    return experiment_grid(asked, {
        "reranker_type": ["pass_through", "cross_encoder"], "prompt_version": ["v1", "v2"], "quality_mode": ["default", "cheap", "high_quality"],
    })


EXPERIMENT_GRID = """SELECT item_id, text AS question, r AS reranker_type, p AS prompt_version, q AS quality_mode
FROM benchmark, unnest(['pass_through', 'cross_encoder']) a(r), unnest(['v1', 'v2']) b(p), unnest(['default', 'cheap', 'high_quality']) c(q)"""


def words_sql(text: str) -> str:
    return f"""list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-zA-Z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(
      ['a','an','and','are','as','at','be','by','for','from','how','in','is','it','of','on','or','that','the','this','to','what','with'], w)))"""


def scores_sql(source: str, name: str = "rated") -> str:
    """Scores over ``source(question, answer, context, n_chunks)``; context is the joined text."""
    def clamp(value: str) -> str:
        return exact_sql(f"greatest(0.0::DOUBLE, least(5.0::DOUBLE, {value}))", 2)

    return f"""
{name}_words AS (
  SELECT *, {words_sql("question")} AS q, {words_sql("answer")} AS a, {words_sql("coalesce(context, '')")} AS c FROM {source}
),
{name} AS (
  SELECT *,
    CASE WHEN n_chunks > 0 AND answer <> '' THEN 3.0::DOUBLE WHEN n_chunks > 0 THEN 1.0::DOUBLE WHEN answer <> '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS groundedness,
    CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE {clamp("len(list_intersect(q, a))::DOUBLE / len(q) * 4 + least(len(a)::DOUBLE / 40, 1.0::DOUBLE)")} END AS relevance,
    {clamp("1.5::DOUBLE * (regexp_matches(answer, '(?i)\\barticle\\s+\\d+\\b')::INT + regexp_matches(answer, '(?i)\\bchunk\\s+\\d+\\b')::INT + regexp_matches(answer, '\\[\\d+\\]')::INT + regexp_matches(answer, '(?i)\\bclause\\s+\\d+\\b')::INT)")} AS citation,
    CASE WHEN regexp_full_match(answer, '\\s*') THEN 0.0::DOUBLE
      WHEN len(c) = 0 THEN {clamp("least(len(a)::DOUBLE / 20, 1.0::DOUBLE) * 5")}
      ELSE {clamp("len(list_intersect(a, c))::DOUBLE / greatest(least(len(c), 30), 1) * 4 + least(len(a)::DOUBLE / 50, 1.0::DOUBLE)")} END AS completeness
  FROM {name}_words
)"""


def cited(answer: Column, turn: Column) -> Column:
    """Answers with traces of citations, by turn."""
    return F.when(turn % 4 == 0, F.concat(answer, F.lit(" See Article 5 [1]."))).when(
        turn % 4 == 2, F.concat(answer, F.lit(" (chunk 2, CLAUSE 3)"))
    ).otherwise(answer)


CITED_SQL = """CASE turn % 4 WHEN 0 THEN answer || ' See Article 5 [1].' WHEN 2 THEN answer || ' (chunk 2, CLAUSE 3)' ELSE answer END"""


def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    context = gather_context(earlier_turns(spark, folder), "content")
    rated = (
        exchanges(spark, folder)
        .withColumn("answer", F.when(F.col("answer") != "", cited(F.col("answer"), F.col("turn"))).otherwise(""))
        .join(context, "query_id", "left")
        .withColumn("q", content_words(F.col("question")))
        .withColumn("a", content_words(F.col("answer")))
        .withColumn("c", content_words(F.coalesce(F.array_join(F.transform("context", lambda c: c["content"]), " "), F.lit(""))))
    )
    return rated.select(
        "query_id",
        groundedness(F.col("answer"), F.col("context").isNotNull()).alias("groundedness"),
        answer_relevance(F.col("q"), F.col("a")).alias("relevance"),
        citation_presence(F.col("answer")).alias("citation"),
        completeness(F.col("answer"), F.col("a"), F.col("c")).alias("completeness"),
    )


ANSWER_SCORES = f"""WITH {EXCHANGES_SQL},
joined AS (
  SELECT x.query_id, any_value(question) AS question, any_value(CASE WHEN answer = '' THEN '' ELSE {CITED_SQL} END) AS answer,
    string_agg(e.content, ' ' ORDER BY rank) AS context, count(e.rank) AS n_chunks
  FROM exchanges x LEFT JOIN earlier e ON e.query_id = x.query_id GROUP BY 1
),{scores_sql("joined")}
SELECT query_id, groundedness, relevance, citation, completeness FROM rated"""


def legal_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return stored_legal_chunks(spark, folder).withColumn("task", F.lit("legal_qa"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """User turns answered from the legal corpus: the assistant turn is the first reply, and every
    fourth first call fails."""
    asked = exchanges(spark, folder).withColumn("task", F.lit("legal_qa"))
    # Requests out of scope name a version and a provider that do not exist; they end before either is looked up.
    outside = scope_label(F.col("question"), F.col("task"))["status"] != "in_scope"
    requests = asked.select(
        "query_id", "question", "task",
        F.when(outside, "unsupported").when(F.col("turn") % 3 == 0, "view").otherwise("click").alias("quality_mode"),
        F.when(outside, "v0").otherwise("v1").alias("prompt_version"),
    )
    call = F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")
    answers = asked.select("query_id", "conv_id", "turn", "answer", call).select(
        "query_id", "attempt",
        ((F.col("attempt") == 2) | (F.col("conv_id") % 4 != 1)).alias("ok"),
        F.when(F.col("attempt") == 1, cited(F.col("answer"), F.col("turn"))).otherwise(F.lit("Second try [2].")).alias("answer"),
        F.length("answer").alias("prompt_tokens"), (F.col("turn") * 11 + F.col("attempt")).cast("int").alias("completion_tokens"),
        (F.col("turn") * 1.5).alias("latency_ms"), F.lit(None).cast("double").alias("provider_reported_cost_usd"),
        F.lit(None).cast("string").alias("provider_generation_id"), F.lit(None).cast("string").alias("provider_usage_source"),
    )
    settings = RetrievalSettings(mode="lexical", lexical_backend="bm25", stemming=False)
    prepared = prepare_prompts(
        requests, legal_corpus(spark, folder), templates(spark), rule_table(parse_rules(RULES_JSON) | UNSUPPORTED_RULE), settings,
        modes=("lexical",), backends=("bm25",),
    )
    return assemble_responses(prepared, answers).select(
        "query_id", "answer", "provider", "model", "fallback_used", "failed", "abstained", "guardrail_reason", "scope_status",
        "evidence_status", "routing_reason", "routing_notes", F.col("total_tokens").cast("bigint").alias("total_tokens"),
        "groundedness_score", "answer_relevance_score", "citation_score", "completeness_score", "estimated_cost_usd",
        F.array_join("retrieved_chunk_ids", ";").alias("chunk_ids"),
    )


RESPONSES = f"""WITH {LEGAL_CHUNKS_SQL},{EXCHANGES_SQL},
asked AS (SELECT query_id, conv_id, turn, question, 'legal_qa' AS task, answer AS reply FROM exchanges),{scope_sql("asked")},
corpus_chunks AS (SELECT chunk_id, 'legal_qa' AS task, chunk_index, content, article_number, clause_number FROM legal_chunks),
searched AS (SELECT query_id, task, question FROM scoped WHERE scope_status = 'in_scope'),{terms_sql("searched")},{postings_sql("corpus_chunks", True)},{BM25_SQL},
listed AS (
  SELECT q.query_id, p.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.chunk_index, p.chunk_id) AS rank
  FROM asked_terms q JOIN corpus_chunks p ON p.task = q.task AND (q.article_number IS NULL OR q.article_number = p.article_number)
    AND (q.clause_number IS NULL OR list_contains(p.clause_number, CAST(q.clause_number AS BIGINT)))
  WHERE len(q.terms) = 0
),
found AS (
  SELECT query_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 4 UNION ALL SELECT query_id, chunk_id, rank FROM listed WHERE rank <= 4
),
contexts AS (
  SELECT f.query_id, string_agg(f.chunk_id, ';' ORDER BY rank) AS chunk_ids, string_agg(c.content, ' ' ORDER BY rank) AS context,
    count(*) AS n_chunks, list(c.article_number ORDER BY rank) FILTER (WHERE rank <= 3) AS tops
  FROM found f JOIN corpus_chunks c ON c.chunk_id = f.chunk_id GROUP BY 1
),
called AS (
  SELECT s.*, chunk_ids, context, coalesce(n_chunks, 0) AS n_chunks, coalesce(list_contains(tops, asked), false) AS in_top,
    turn % 3 = 0 AS viewed, conv_id % 4 <> 1 AS first_ok,
    CASE WHEN conv_id % 4 = 1 AND turn % 3 = 0 THEN 'Second try [2].' ELSE
      CASE turn % 4 WHEN 0 THEN reply || ' See Article 5 [1].' WHEN 2 THEN reply || ' (chunk 2, CLAUSE 3)' ELSE reply END END AS answer,
    CASE WHEN conv_id % 4 = 1 AND turn % 3 = 0 THEN 2 ELSE 1 END AS attempt
  FROM scoped s LEFT JOIN contexts c ON c.query_id = s.query_id
),{scores_sql("called")},
labelled AS (SELECT *, {EVIDENCE_SQL} FROM rated),
decided AS (
  SELECT *, CASE WHEN scope_status <> 'in_scope' THEN scope_reason WHEN evidence_status <> 'sufficient' THEN evidence_reason END AS why,
    CASE WHEN viewed AND first_ok THEN 'openrouter' ELSE 'openai' END AS provider,
    CASE WHEN viewed THEN CASE WHEN first_ok THEN 'openai/gpt-4.1-mini' ELSE 'gpt-4.1-mini' END ELSE 'gpt-4.1' END AS model,
    length(reply) AS prompt_tokens, turn * 11 + attempt AS completion_tokens
  FROM labelled
)
SELECT query_id,
  CASE WHEN why IS NULL THEN answer WHEN scope_status <> 'in_scope' THEN '{OUT_OF_SCOPE_ANSWER}' ELSE '{NO_EVIDENCE_ANSWER.replace(QUOTE, QUOTE * 2)}' END AS answer,
  CASE WHEN why IS NULL THEN provider ELSE 'guardrail' END AS provider, CASE WHEN why IS NULL THEN model ELSE 'guardrail' END AS model,
  why IS NULL AND viewed AND NOT first_ok AS fallback_used, why IS NULL AND NOT viewed AND NOT first_ok AS failed,
  why IS NOT NULL AS abstained, why AS guardrail_reason, scope_status,
  CASE WHEN scope_status = 'in_scope' THEN evidence_status END AS evidence_status,
  coalesce(why, 'task override for ''legal_qa'' in quality mode ''' || CASE WHEN viewed THEN 'view' ELSE 'click' END || '''') AS routing_reason,
  coalesce(why, CASE WHEN viewed AND NOT first_ok THEN 'Fallback used: openrouter/openai/gpt-4.1-mini -> openai/gpt-4.1-mini' END) AS routing_notes,
  CASE WHEN why IS NULL THEN prompt_tokens + completion_tokens ELSE 0 END::BIGINT AS total_tokens,
  CASE WHEN why IS NULL THEN groundedness ELSE 0 END AS groundedness_score, CASE WHEN why IS NULL THEN relevance ELSE 0 END AS answer_relevance_score,
  CASE WHEN why IS NULL THEN citation ELSE 0 END AS citation_score, CASE WHEN why IS NULL THEN completeness ELSE 0 END AS completeness_score,
  CASE WHEN why IS NULL THEN {exact_sql("prompt_tokens::DOUBLE / 1000000 * CASE WHEN viewed THEN 0.8::DOUBLE ELSE 3.0::DOUBLE END + completion_tokens::DOUBLE / 1000000 * CASE WHEN viewed THEN 3.2::DOUBLE ELSE 12.0::DOUBLE END", 6)} ELSE 0 END AS estimated_cost_usd,
  chunk_ids
FROM decided"""


def abstentions(spark: SparkSession, folder: str) -> DataFrame:
    """The guardrail part of the answer flow over conversations: candidates are the earlier turns."""
    labelled = label_evidence(
        exchanges(spark, folder).withColumn("scope", scope_label(F.col("question"), F.col("task"))),
        earlier_turns(spark, folder, EVIDENCE_DEPTH),
    )
    reason = abstention_reason(F.col("scope"), F.col("evidence"))
    return labelled.select(
        "query_id", reason.isNotNull().alias("abstained"), reason.alias("reason"),
        F.when(reason.isNotNull(), abstention_answer(F.col("scope"))).otherwise(F.col("answer")).alias("answer"),
    )


ABSTENTIONS = f"""WITH {EXCHANGES_SQL},{scope_sql("exchanges")},
seen AS (
  SELECT s.query_id, any_value(s.asked) AS asked, any_value(scope_status) AS scope_status, any_value(scope_reason) AS scope_reason,
    any_value(answer) AS answer, count(e.rank) AS n_chunks, coalesce(bool_or(e.article_number = s.asked), false) AS in_top
  FROM scoped s LEFT JOIN earlier e ON e.query_id = s.query_id AND e.rank <= 3 GROUP BY 1
),
labelled AS (SELECT *, {EVIDENCE_SQL} FROM seen)
SELECT query_id, scope_status <> 'in_scope' OR evidence_status <> 'sufficient' AS abstained,
  CASE WHEN scope_status <> 'in_scope' THEN scope_reason WHEN evidence_status <> 'sufficient' THEN evidence_reason END AS reason,
  CASE WHEN scope_status <> 'in_scope' THEN '{OUT_OF_SCOPE_ANSWER}' WHEN evidence_status <> 'sufficient'
    THEN '{NO_EVIDENCE_ANSWER.replace(QUOTE, QUOTE * 2)}' ELSE answer END AS answer
FROM labelled"""

QUERIES = {
    "scope_labels": (scope_labels, SCOPE_LABELS),
    "evidence_labels": (evidence_labels, EVIDENCE_LABELS),
    "abstentions": (abstentions, ABSTENTIONS),
    "routing_decisions": (routing_decisions, ROUTING_DECISIONS),
    "fallback_outcome": (fallback_outcomes, FALLBACK_OUTCOME),
    "prompt_assembly": (prompt_assembly, PROMPT_ASSEMBLY),
    "request_cost": (request_costs, REQUEST_COST),
    "display_cost": (display_costs, DISPLAY_COST),
    "experiment_grid": (grid, EXPERIMENT_GRID),
    "answer_scores": (answer_scores, ANSWER_SCORES),
    "responses": (responses, RESPONSES),
}
