"""Queries of retrieval metrics, benchmark building, pooling and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.benchmark_text import (
    GENERATION_HEAD, JUDGE_HEAD, generation_prompt, heuristic_gold_answer, is_yes, judge_prompt,
)
from corpusmill.operators.benchmark import build_dataset, heuristic_content, merge_replies
from corpusmill.operators.dense import dense_topk
from corpusmill.operators.lexical_index import analyzed, term_statistics, vocabulary
from corpusmill.operators.lexical_search import bm25_topk, fts_topk
from corpusmill.operators.metrics import mean_metrics, metric_names, sample_metrics, worst_samples
from corpusmill.operators.pooling import expand_labels, pool_candidates
from corpusmill.operators.reports import compare_reports, generation_method, metric_map, pivot_metrics
from corpusmill.operators.retrieve import RetrievalSettings, with_chunk_columns
from corpusmill.operators.review import (
    apply_edits, edits_out_of_range, filter_reviewed, list_samples, review_counts,
)
from corpusmill.operators.sampling import evenly_spaced
from corpusmill.plans.catalog import inputs
from corpusmill.plans.catalog.corpus import stored_legal_chunks
from corpusmill.plans.catalog.inputs import CHUNKS_SQL, DOCUMENTS_SQL, LEGAL_CHUNKS_SQL, QUESTIONS_SQL
from corpusmill.plans.catalog.retrieval import (
    BM25_SQL, CENTROID_SQL, DENSE_SQL, FTS_SQL, chunks, embedded_chunks, embedded_questions,
    label_centroids, lexical_queries, postings_sql, stored_vectors, terms_sql,
)
from corpusmill.plans.evaluate import evaluate_retrieval
from corpusmill.session import stored

K_VALUES = (1, 3, 5, 10)
DIGITS = 6


def plain_name(metric: str) -> str:
    """hit_rate@3 as hit_rate_3."""
    return metric.replace("@", "_")


def rounded(frame: DataFrame, *kept: str) -> DataFrame:
    return frame.select(*kept, *[F.round(F.col(f"`{m}`"), DIGITS).alias(plain_name(m)) for m in metric_names(K_VALUES)])


def metrics_sql(ranked: str, labels: str, samples: str, name: str = "measured") -> str:
    """Metrics per query of ``ranked(query_id, chunk_id, rank)`` against ``labels(query_id, chunk_id)``."""
    columns = []
    for k in K_VALUES:
        ideal = f"list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))"
        columns += [
            f"CASE WHEN count(*) FILTER (WHERE hit AND rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_{k}",
            f"count(*) FILTER (WHERE hit AND rank <= {k})::DOUBLE / {k} AS precision_{k}",
            f"CASE WHEN any_value(n_rel) = 0 THEN 0 ELSE count(*) FILTER (WHERE hit AND rank <= {k})::DOUBLE / any_value(n_rel) END AS recall_{k}",
            f"CASE WHEN any_value(n_rel) = 0 THEN 0 ELSE coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE hit AND rank <= {k}), 0) / any_value({ideal}) END AS ndcg_{k}",
        ]
    listed = ",\n    ".join(columns)
    return f"""
{name} AS (
  SELECT query_id, {listed},
    coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 0) AS mrr
  FROM (
    SELECT s.query_id, r.rank, l.chunk_id IS NOT NULL AS hit,
      (SELECT count(*) FROM {labels} n WHERE n.query_id = s.query_id) AS n_rel
    FROM {samples} s LEFT JOIN {ranked} r ON r.query_id = s.query_id
      LEFT JOIN {labels} l ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id)
  GROUP BY query_id
)"""


METRIC_COLUMNS = [plain_name(m) for m in metric_names(K_VALUES)]
ROUNDED_SQL = ", ".join(f"round({m}, {DIGITS}) AS {m}" for m in METRIC_COLUMNS)
MEANS_SQL = ", ".join(f"round(avg({m}), {DIGITS}) AS {m}" for m in METRIC_COLUMNS)


def _label_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors nearest to the mean of a label; those of the same label are relevant."""
    asked, stored = label_centroids(spark, folder), stored_vectors(spark, folder)
    relevant = stored.select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("query_id"), "chunk_id")
    return sample_metrics(asked.select("query_id", "label"), dense_topk(asked, stored, max(K_VALUES)), relevant, K_VALUES)


LABEL_METRICS_SQL = f"""{CENTROID_SQL},
label_samples AS (SELECT 'label:' || label AS query_id, label FROM centroids),
label_labels AS (SELECT 'label:' || label AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings),
label_lists AS (SELECT query_id, chunk_id, rank FROM label_ranked WHERE rank <= 10),{metrics_sql("label_lists", "label_labels", "label_samples")}"""


def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_label_metrics(spark, folder), "query_id")


IR_METRICS = f"WITH {LABEL_METRICS_SQL} SELECT query_id, {ROUNDED_SQL} FROM measured"


def ir_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mean_metrics(_label_metrics(spark, folder), K_VALUES), "n_samples")


IR_AGGREGATE = f"WITH {LABEL_METRICS_SQL} SELECT count(*) AS n_samples, {MEANS_SQL} FROM measured"


def worst_mrr(spark: SparkSession, folder: str) -> DataFrame:
    worst = worst_samples(_label_metrics(spark, folder), "label", 5)
    return worst.select("query_id", F.round("mrr", DIGITS).alias("mrr"))


WORST_MRR = f"""WITH {LABEL_METRICS_SQL}
SELECT m.query_id, round(mrr, {DIGITS}) AS mrr FROM measured m JOIN label_samples s ON s.query_id = m.query_id
ORDER BY m.mrr, s.label LIMIT 5"""


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports of one experiment and one of another: forward lists, reversed lists, first places."""
    asked, stored = label_centroids(spark, folder), stored_vectors(spark, folder)
    relevant = stored.select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("query_id"), "chunk_id")
    found = dense_topk(asked, stored, max(K_VALUES))
    variants = [
        ("forward", "e1", found),
        ("reversed", "e1", found.withColumn("rank", F.lit(max(K_VALUES) + 1) - F.col("rank"))),
        ("first", "e2", found.filter("rank = 1")),
    ]
    reports = None
    for name, experiment, lists in variants:
        means = mean_metrics(sample_metrics(asked.select("query_id"), lists, relevant, K_VALUES), K_VALUES)
        config = F.create_map(
            F.lit("experiment_id"), F.lit(experiment), F.lit("retrieval_mode"), F.lit("dense"),
            F.lit("reranker_type"), F.lit(name), F.lit("dataset_generation_method"), F.lit("labels"),
        )
        report = means.select(
            metric_map(metric_names(K_VALUES)).alias("aggregate"), "n_samples", config.alias("config"), F.lit(f"{name}.json").alias("file")
        )
        reports = report if reports is None else reports.unionByName(report)
    return reports


COMPARED = ("hit_rate@1", "hit_rate@3", "mrr", "precision@1", "precision@3")


def report_compare(spark: SparkSession, folder: str) -> DataFrame:
    compared = compare_reports(_reports(spark, folder), "e1", COMPARED)
    return compared.select(
        "experiment_id", "dataset_generation_method", "retrieval_mode", "reranker_type", "n_samples", "file",
        *[F.round(F.col(f"`{m}`"), DIGITS).alias(plain_name(m)) for m in COMPARED],
    )


COMPARED_SQL = ", ".join(f"round(avg({plain_name(m)}), {DIGITS}) AS {plain_name(m)}" for m in COMPARED)
REPORT_COMPARE = f"""WITH {LABEL_METRICS_SQL},
reversed_lists AS (SELECT query_id, chunk_id, 11 - rank AS rank FROM label_lists),{metrics_sql("reversed_lists", "label_labels", "label_samples", "reversed_measured")}
SELECT 'e1' AS experiment_id, 'labels' AS dataset_generation_method, 'dense' AS retrieval_mode, 'forward' AS reranker_type,
  count(*) AS n_samples, 'forward.json' AS file, {COMPARED_SQL} FROM measured
UNION ALL
SELECT 'e1', 'labels', 'dense', 'reversed', count(*), 'reversed.json', {COMPARED_SQL} FROM reversed_measured"""


def report_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison from long form."""
    long_form = _reports(spark, folder).select(F.col("file").alias("report"), F.explode("aggregate").alias("metric", "value"))
    pivoted = pivot_metrics(long_form, ["mrr", "recall@10"])
    return pivoted.select("report", F.round("mrr", DIGITS).alias("mrr"), F.round(F.col("`recall@10`"), DIGITS).alias("recall_10"))


REPORT_PIVOT = f"""WITH {LABEL_METRICS_SQL},
reversed_lists AS (SELECT query_id, chunk_id, 11 - rank AS rank FROM label_lists),{metrics_sql("reversed_lists", "label_labels", "label_samples", "reversed_measured")},
first_lists AS (SELECT * FROM label_lists WHERE rank = 1),{metrics_sql("first_lists", "label_labels", "label_samples", "first_measured")}
SELECT 'forward.json' AS report, round(avg(mrr), 6) AS mrr, round(avg(recall_10), 6) AS recall_10 FROM measured
UNION ALL SELECT 'reversed.json', round(avg(mrr), 6), round(avg(recall_10), 6) FROM reversed_measured
UNION ALL SELECT 'first.json', round(avg(mrr), 6), round(avg(recall_10), 6) FROM first_measured"""

SAMPLES = 100
#: The harness asks with all chunks of documents whose id is divisible by this.
HARNESS_DOCUMENTS = 50


def bench_sample(spark: SparkSession, folder: str) -> DataFrame:
    sampled = evenly_spaced(chunks(spark, folder), SAMPLES)
    return sampled.select("sample_pos", "chunk_id")


BENCH_SAMPLE_SQL = f"""
placed AS (SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS pos, count(*) OVER () AS n FROM chunks),
sampled AS (
  SELECT i AS sample_pos, p.* FROM range({SAMPLES}) r(i) JOIN placed p
    ON p.pos = CASE WHEN p.n <= {SAMPLES} THEN i ELSE CAST(floor(i * (p.n::DOUBLE / {SAMPLES})) AS BIGINT) END
)"""
BENCH_SAMPLE = f"WITH {CHUNKS_SQL},{BENCH_SAMPLE_SQL} SELECT sample_pos, chunk_id FROM sampled"


def bench_questions(spark: SparkSession, folder: str) -> DataFrame:
    """A sample for every chunk of the legal text."""
    content = heuristic_content(evenly_spaced(stored_legal_chunks(spark, folder)))
    built = build_dataset(content)
    return built.select(
        "sample_pos", "question", F.array_join("relevant_chunk_ids", ";").alias("relevant"), "gold_answer",
        F.element_at("metadata", "review_status").alias("review_status"),
        F.element_at("metadata", "article_number").alias("article_number"),
    )


TOPIC_SQL = """CASE WHEN plain = '' THEN 'this provision' ELSE rtrim(array_to_string(list_filter(regexp_split_to_array(
    coalesce(nullif(regexp_extract(plain, '^(.*?[.!?])\\s', 1), ''), plain), '\\s+'), lambda w: w <> '')[1:8], ' '), '.,:;') END"""
GOLD_SQL = """nullif(substring(coalesce(list_filter(string_split(regexp_replace(plain, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: length(s) >= 40)[1], plain), 1, 280), '')"""

BENCH_QUESTIONS = f"""WITH {LEGAL_CHUNKS_SQL},
described AS (
  SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS sample_pos,
    trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain,
    CASE WHEN article_number IS NOT NULL THEN 'Article ' || article_number || CASE WHEN len(clause_number) > 0 THEN ', Clause ' || clause_number[1] ELSE '' END END AS place,
    nullif(lower(trim(trim(article_title), '.')), '') AS about
  FROM legal_chunks
),
asked AS (
  SELECT *, {TOPIC_SQL} AS topic, {GOLD_SQL} AS gold_answer,
    CASE WHEN place IS NOT NULL AND about IS NOT NULL AND chunk_index % 2 = 0 THEN 'What does ' || place || ' say about ' || about || '?'
      WHEN place IS NOT NULL AND about IS NOT NULL THEN 'How does ' || place || ' address ' || about || '?'
      WHEN place IS NOT NULL THEN 'What does ' || place || ' say?'
      ELSE 'What does this section say about ' || ({TOPIC_SQL}) || '?' END AS base
  FROM described
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY sample_pos) AS nth FROM asked)
SELECT sample_pos, CASE WHEN nth = 1 THEN base ELSE base || ' (passage ' || nth || ')' END AS question, chunk_id AS relevant,
  gold_answer, 'auto_generated' AS review_status, article_number FROM numbered"""


def bench_gold(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", heuristic_gold_answer(F.col("content")).alias("gold_answer"))


BENCH_GOLD = f"""WITH {CHUNKS_SQL},
plained AS (SELECT chunk_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain FROM chunks)
SELECT chunk_id, {GOLD_SQL} AS gold_answer FROM plained"""


def generation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    title = F.when(F.col("document_id") % 4 != 0, F.col("title"))
    return chunks(spark, folder).select("chunk_id", generation_prompt(title, F.col("content")).alias("prompt"))


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GENERATION_PROMPTS = f"""WITH {CHUNKS_SQL}
SELECT chunk_id, {literal(GENERATION_HEAD)} || 'Document title: ' || CASE WHEN document_id % 4 = 0 THEN 'unknown' ELSE title END
  || chr(10) || 'Chunk content:' || chr(10) || content || chr(10) AS prompt FROM chunks"""


def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt for every chunk with its own heuristic answer as question."""
    return chunks(spark, folder).select(
        "chunk_id", judge_prompt(heuristic_gold_answer(F.col("content")), F.col("content")).alias("prompt")
    )


JUDGE_PROMPTS = f"""WITH {CHUNKS_SQL},
plained AS (SELECT chunk_id, content, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain FROM chunks)
SELECT chunk_id, {literal(JUDGE_HEAD)} || 'Question:' || chr(10) || ({GOLD_SQL}) || chr(10) || chr(10) || 'Passage:' || chr(10)
  || content || chr(10) AS prompt FROM plained"""


def model_json_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of six kinds, by document: plain, fenced, wrapped in words, without answer, broken, a list."""
    corpus = chunks(spark, folder)
    kind = F.col("document_id") % 6
    question = F.concat(F.lit("Asked of "), "chunk_id")
    full = F.to_json(F.struct(question.alias("question"), F.lit(" From the chunk ").alias("gold_answer")))
    raw = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), full, F.lit(" Enjoy!")))
        .when(kind == 3, F.to_json(F.struct(question.alias("question"), F.lit("  ").alias("gold_answer"))))
        .when(kind == 4, F.lit("not valid json"))
        .otherwise(F.concat(F.lit("["), full, F.lit("]")))
    )
    merged = merge_replies(corpus, corpus.select("chunk_id", raw.alias("raw")), "openai", "gpt-4.1-mini")
    return merged.select("chunk_id", F.col("base_question").alias("question"), "gold_answer", "generation_note")


MODEL_JSON_MERGE = f"""WITH {CHUNKS_SQL},
plained AS (SELECT chunk_id, document_id % 6 AS kind, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain FROM chunks)
SELECT chunk_id,
  CASE WHEN kind <= 3 THEN 'Asked of ' || chunk_id ELSE 'What does this section say about ' || ({TOPIC_SQL}) || '?' END AS question,
  CASE WHEN kind <= 2 THEN 'From the chunk' ELSE {GOLD_SQL} END AS gold_answer,
  CASE WHEN kind = 3 THEN 'llm_gold_answer_missing_fell_back_to_heuristic'
    WHEN kind > 3 THEN 'llm_question_missing_fell_back_to_heuristic; llm_gold_answer_missing_fell_back_to_heuristic' END AS generation_note
FROM plained"""


def yes_no_parse(spark: SparkSession, folder: str) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit(" Yes, "), "text"))
        .when(kind == 1, F.concat(F.lit("NO. "), "text"))
        .when(kind == 2, F.concat(F.lit("**Relevant** 1"), "text"))
        .when(kind == 3, F.lit("42"))
        .when(kind == 4, F.concat(F.lit("1. true\n"), "text"))
        .otherwise(F.col("text"))
    )
    return inputs.table(spark, folder, "conversations").select("conv_id", "turn", is_yes(raw).alias("verdict"))


YES_NO_PARSE = """SELECT conv_id, turn, regexp_extract(lower(CASE (conv_id + turn) % 6 WHEN 0 THEN ' Yes, ' || text WHEN 1 THEN 'NO. ' || text
  WHEN 2 THEN '**Relevant** 1' || text WHEN 3 THEN '42' WHEN 4 THEN '1. true' || chr(10) || text ELSE text END), '[a-z]+')
  IN ('yes', 'y', 'true', 'relevant') AS verdict FROM conversations"""

POOL_K = 10


def _pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pool of dense, full-text and BM25 results, and the dense lists."""
    corpus = embedded_chunks(spark, folder)
    plain = chunks(spark, folder)
    asked = lexical_queries(inputs.questions(spark, folder))
    posted = analyzed(plain)
    statistics = term_statistics(plain, asked.select(F.explode("terms").alias("term")))
    dense = dense_topk(embedded_questions(spark, folder), corpus, POOL_K)
    text = fts_topk(asked, posted, POOL_K, stemming=False, vocabulary=vocabulary(plain))
    return pool_candidates([dense, text, bm25_topk(asked, posted, statistics, POOL_K)]), dense


POOL_SQL = f"""{CHUNKS_SQL},{QUESTIONS_SQL},{DENSE_SQL},{terms_sql("questions")},{postings_sql()},{BM25_SQL},{FTS_SQL},
pool AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_order, rank) AS nth FROM (
      SELECT query_id, chunk_id, 0 AS source_order, rank FROM dense_ranked WHERE rank <= {POOL_K}
      UNION ALL SELECT query_id, chunk_id, 1, rank FROM fts_ranked WHERE rank <= {POOL_K}
      UNION ALL SELECT query_id, chunk_id, 2, rank FROM bm25_ranked WHERE rank <= {POOL_K}))
  WHERE nth = 1
)"""


def pooled(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder)[0].select(
        "query_id", "chunk_id", F.col("source_order").cast("bigint").alias("source_order"), F.col("rank").cast("bigint").alias("rank")
    )


POOL_CANDIDATES = f"WITH {POOL_SQL} SELECT query_id, chunk_id, source_order::BIGINT AS source_order, rank FROM pool"


def pool_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The first dense result is the label; verdicts follow from the length of the chunk."""
    pool, dense = (stored(frame, "pool") for frame in _pool(spark, folder))
    samples = dense.filter("rank = 1").select("query_id", F.array("chunk_id").alias("relevant_chunk_ids"))
    said = F.when(F.length("content") % 3 == 0, "Yes.").when(F.length("content") % 3 == 1, "no")
    verdicts = with_chunk_columns(pool.select("query_id", "chunk_id"), chunks(spark, folder), "content").withColumn("raw", said)
    expanded = expand_labels(samples, pool, verdicts)
    return expanded.select(
        "query_id", F.array_join("relevant_chunk_ids", ";").alias("relevant"), F.array_join("candidates_judged", ";").alias("judged"),
    )


POOL_LABELS = f"""WITH {POOL_SQL},
judged AS (
  SELECT p.*, length(c.content) % 3 = 0 AS yes FROM pool p JOIN chunks c ON c.chunk_id = p.chunk_id
  WHERE NOT (p.source_order = 0 AND p.rank = 1)
)
SELECT d.query_id, concat_ws(';', any_value(d.chunk_id), string_agg(j.chunk_id, ';' ORDER BY source_order, j.rank) FILTER (WHERE yes)) AS relevant,
  coalesce(string_agg(j.chunk_id, ';' ORDER BY source_order, j.rank), '') AS judged
FROM (SELECT * FROM dense_ranked WHERE rank = 1) d LEFT JOIN judged j ON j.query_id = d.query_id GROUP BY d.query_id"""


def eval_harness(spark: SparkSession, folder: str) -> DataFrame:
    """Heuristic questions of all chunks of every fiftieth document, asked of all chunks with BM25; corpus and samples are stored first."""
    corpus = stored(chunks(spark, folder), "chunks")
    asked = evenly_spaced(corpus).filter(F.col("document_id") % HARNESS_DOCUMENTS == 0)
    built = build_dataset(heuristic_content(asked))
    samples = built.select(
        F.col("sample_pos").cast("string").alias("query_id"), "question", "relevant_chunk_ids",
    ).join(
        corpus.select(F.col("chunk_id").alias("own"), "task"), F.col("own") == F.col("relevant_chunk_ids")[0]
    ).drop("own")
    samples = stored(samples, "samples")
    settings = RetrievalSettings(mode="lexical", lexical_backend="bm25", stemming=False)
    measured = evaluate_retrieval(samples, corpus, settings, K_VALUES, modes=("lexical",), backends=("bm25",))
    return rounded(measured, "query_id", "question").withColumn("n_relevant", F.lit(1))


EVAL_HARNESS = f"""WITH {CHUNKS_SQL},
placed AS (SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS sample_pos FROM chunks),
plained AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS plain FROM placed WHERE document_id % {HARNESS_DOCUMENTS} = 0),
based AS (SELECT *, 'What does this section say about ' || ({TOPIC_SQL}) || '?' AS base FROM plained),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY sample_pos) AS nth FROM based),
samples AS (
  SELECT CAST(sample_pos AS VARCHAR) AS query_id, task, chunk_id,
    CASE WHEN nth = 1 THEN base ELSE base || ' (passage ' || nth || ')' END AS question FROM numbered
),{terms_sql("samples")},{postings_sql()},{BM25_SQL},
lists AS (SELECT query_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 10),{metrics_sql("lists", "samples", "samples")}
SELECT m.query_id, s.question, {ROUNDED_SQL}, 1 AS n_relevant FROM measured m JOIN samples s ON s.query_id = m.query_id"""


def reviewed_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A sample per document; its labels give the review status."""
    docs, labels = inputs.documents(spark, folder), inputs.table(spark, folder, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "auto_generated")
    entries = F.create_map(
        F.lit("review_status"), status, F.lit("reviewer_note"), F.when(F.col("toxic") == 0, "seen"),
        F.lit("generation_method"), F.when(F.col("quality") == 1, " heuristic ").when(F.col("quality") == 0, "llm"),
    )
    return docs.join(labels, F.col("doc_id") == F.col("document_id"), "left").select(
        F.col("document_id").alias("sample_pos"), F.concat(F.lit("Question "), F.col("document_id").cast("string")).alias("question"),
        F.array("source_path").alias("relevant_chunk_ids"), F.when(F.coalesce("quality", F.lit(1)) == 1, F.col("title")).alias("gold_answer"),
        F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metadata"),
    )


REVIEWED_SQL = f"""{DOCUMENTS_SQL},
reviewed AS (
  SELECT document_id AS sample_pos, 'Question ' || document_id AS question, source_path AS relevant,
    CASE WHEN coalesce(quality, 1) = 1 THEN title END AS gold_answer, toxic, quality,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'auto_generated' ELSE 'unreviewed' END AS status,
    CASE WHEN toxic = 0 THEN 'seen' END AS note
  FROM docs LEFT JOIN labels ON doc_id = document_id
)"""


def review_count(spark: SparkSession, folder: str) -> DataFrame:
    return review_counts(reviewed_samples(spark, folder))


REVIEW_COUNTS = f"WITH {REVIEWED_SQL} SELECT status AS review_status, count(*) AS n FROM reviewed GROUP BY 1"


def review_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = filter_reviewed(reviewed_samples(spark, folder), {"approved", "unreviewed", "rejected"}, {"rejected"})
    return kept.select("sample_pos", "question")


REVIEW_FILTER = f"WITH {REVIEWED_SQL} SELECT sample_pos, question FROM reviewed WHERE status IN ('approved', 'unreviewed')"


def review_list(spark: SparkSession, folder: str) -> DataFrame:
    return list_samples(reviewed_samples(spark, folder), status="rejected").select("sample_pos", "question")


REVIEW_LIST = f"WITH {REVIEWED_SQL} SELECT sample_pos, question FROM reviewed WHERE status = 'rejected'"


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits from events: event n edits sample n, in one of five ways."""
    kind = F.col("event_id") % 5
    return inputs.table(spark, folder, "events").select(
        F.col("event_id").alias("sample_pos"),
        F.when(kind == 0, "approved").when(kind == 3, "rejected").alias("status"),
        F.when(kind == 1, F.concat(F.lit("  Reworded by "), F.col("user_id").cast("string"), F.lit(" "))).alias("question"),
        F.when(kind == 1, F.lit("New answer ")).when(kind == 2, F.lit("   ")).alias("gold_answer"),
        F.when(kind == 2, F.array(F.lit(" a "), F.lit(""), F.col("event_type"))).alias("relevant_chunk_ids"),
        F.when(kind == 3, F.lit(" fine note ")).when(kind == 0, F.lit(" ")).alias("reviewer_note"),
        F.when(kind == 4, F.lit(True)).alias("clear_note"),
    )


def review_edits(spark: SparkSession, folder: str) -> DataFrame:
    edited = apply_edits(reviewed_samples(spark, folder), _edits(spark, folder))
    return edited.select(
        "sample_pos", "question", F.array_join("relevant_chunk_ids", ";").alias("relevant"), "gold_answer",
        F.try_element_at("metadata", F.lit("review_status")).alias("status"), F.try_element_at("metadata", F.lit("reviewer_note")).alias("note"),
    )


REVIEW_EDITS = f"""WITH {REVIEWED_SQL}
SELECT sample_pos, CASE WHEN k = 1 THEN 'Reworded by ' || user_id ELSE question END AS question,
  CASE WHEN k = 2 THEN 'a;' || event_type ELSE relevant END AS relevant,
  CASE WHEN k = 1 THEN 'New answer' WHEN k = 2 THEN NULL ELSE gold_answer END AS gold_answer,
  CASE WHEN k = 0 THEN 'approved' WHEN k = 3 THEN 'rejected' ELSE nullif(status, 'unreviewed') END AS status,
  CASE WHEN k = 3 THEN 'fine note' WHEN k IN (0, 4) THEN NULL ELSE note END AS note
FROM reviewed LEFT JOIN (SELECT *, event_id % 5 AS k FROM events) ON event_id = sample_pos"""


def review_bad_edits(spark: SparkSession, folder: str) -> DataFrame:
    return edits_out_of_range(reviewed_samples(spark, folder), _edits(spark, folder)).select("sample_pos")


REVIEW_BAD_EDITS = "SELECT event_id AS sample_pos FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)"


def dataset_method(spark: SparkSession, folder: str) -> DataFrame:
    return generation_method(reviewed_samples(spark, folder))


DATASET_METHOD = f"""WITH {REVIEWED_SQL}
SELECT CASE WHEN count(DISTINCT quality) > 1 THEN 'mixed' WHEN max(quality) = 1 THEN 'heuristic' WHEN max(quality) = 0 THEN 'llm' END
  AS dataset_generation_method FROM reviewed"""

QUERIES = {
    "ir_metrics": (ir_metrics, IR_METRICS),
    "ir_aggregate": (ir_aggregate, IR_AGGREGATE),
    "worst_mrr": (worst_mrr, WORST_MRR),
    "report_compare": (report_compare, REPORT_COMPARE),
    "report_pivot": (report_pivot, REPORT_PIVOT),
    "eval_harness": (eval_harness, EVAL_HARNESS),
    "bench_sample": (bench_sample, BENCH_SAMPLE),
    "bench_questions": (bench_questions, BENCH_QUESTIONS),
    "bench_gold": (bench_gold, BENCH_GOLD),
    "generation_prompts": (generation_prompts, GENERATION_PROMPTS),
    "judge_prompts": (judge_prompts, JUDGE_PROMPTS),
    "model_json_merge": (model_json_merge, MODEL_JSON_MERGE),
    "yes_no_parse": (yes_no_parse, YES_NO_PARSE),
    "pool_candidates": (pooled, POOL_CANDIDATES),
    "pool_labels": (pool_labels, POOL_LABELS),
    "review_counts": (review_count, REVIEW_COUNTS),
    "review_filter": (review_filter, REVIEW_FILTER),
    "review_list": (review_list, REVIEW_LIST),
    "review_edits": (review_edits, REVIEW_EDITS),
    "review_bad_edits": (review_bad_edits, REVIEW_BAD_EDITS),
    "dataset_method": (dataset_method, DATASET_METHOD),
}
