"""Queries that write given tables by a sink and read them back, and those of embedding models, builders and pools."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.embedding import embedding_config
from corpusmill.functions.lexical_query import build_lexical_query, legal_query
from corpusmill.operators.corpus import plain_chunks
from corpusmill.operators.embed import EmbeddingConfigMismatch, config_outcomes, model_embedding, validate_configs
from corpusmill.operators.lexical_search import bm25_topk
from corpusmill.operators.metrics import sample_metrics
from corpusmill.operators.pooling import lexical_backends, pool_sources, pooling_record
from corpusmill.plans.catalog import evaluation, inputs, logs, retrieval
from corpusmill.plans.catalog.inputs import CHUNKS_SQL, DOCUMENTS_SQL, QUESTIONS_SQL, cut_sql
from corpusmill.session import scratch_folder, ship_package, stored
from corpusmill.sources.corpus_store import find_document, read_term_tables, replace_in_store, write_corpus
from corpusmill.sources.datasets import read_dataset, read_questions, write_dataset
from corpusmill.sources.reports import compare_report_files, report_tables, write_report
from corpusmill.sources.request_log import append_log, clear_log, run_rows
from corpusmill.sources.stored_search import bounded_bm25
from corpusmill.sources.text_files import read_text_documents


def text_folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, several to a file, and the lines found in the folder."""
    target = scratch_folder(spark, "text-files")
    inputs.documents(spark, folder).select("content").write.text(target)
    lines = read_text_documents(spark, target).select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.filter("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


TEXT_FOLDER_SCAN = f"""WITH {DOCUMENTS_SQL}
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM docs) WHERE line <> '' GROUP BY line"""


def document_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The stored document of the last source."""
    docs, store = inputs.documents(spark, folder), scratch_folder(spark, "store")
    write_corpus(docs.drop("content"), plain_chunks(docs), store, buckets=4)
    wanted = docs.agg(F.max("source_path")).first()[0]
    return find_document(spark, store, wanted).select("document_id", "task", "source_path", "title")


DOCUMENT_LOOKUP = f"""WITH {DOCUMENTS_SQL}
SELECT document_id, task, source_path, title FROM docs WHERE source_path = (SELECT max(source_path) FROM docs)"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """One sample per document."""
    docs = inputs.documents(spark, folder)
    answer = F.when(F.col("document_id") % 3 != 0, F.concat(F.lit("Answer \"\n"), F.col("title")))
    return docs.select(
        F.col("document_id").alias("sample_pos"), F.concat(F.lit("What is in "), "title", F.lit("?")).alias("question"),
        F.array("source_path").alias("relevant_chunk_ids"), answer.alias("gold_answer"),
        F.create_map(F.lit("lang"), F.col("task"), F.lit("note"), F.lit("kept")).alias("metadata"),
    )


def dataset_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "dataset")
    write_dataset(_samples(spark, folder), target)
    return read_dataset(spark, target).select(
        F.col("sample_pos").cast("bigint").alias("sample_pos"), "question", F.array_join("relevant_chunk_ids", ";").alias("relevant"),
        "gold_answer", F.col("metadata")["lang"].alias("lang"),
    )


DATASET_ROUND_TRIP = f"""WITH {DOCUMENTS_SQL}
SELECT row_number() OVER (ORDER BY document_id) - 1 AS sample_pos, 'What is in ' || title || '?' AS question, source_path AS relevant,
  CASE WHEN document_id % 3 <> 0 THEN 'Answer "' || chr(10) || title END AS gold_answer, task AS lang FROM docs"""


def question_list(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts written as JSON arrays, one file per writing task; every fifth entry has no question."""
    asked = inputs.table(spark, folder, "benchmark")
    entry = F.struct(F.when(F.col("item_id") % 5 != 4, F.concat(F.lit("  "), "text", F.lit(" "))).alias("question"), F.lit("en").alias("task"))
    target = scratch_folder(spark, "questions")
    grouped = asked.groupBy(F.floor(F.col("item_id") / 1000)).agg(F.to_json(F.collect_list(entry)).alias("value"))
    grouped.select("value").write.text(target)
    return read_questions(spark, target).select("question", "task")


QUESTION_LIST = "SELECT trim(text, ' ' || chr(10)) AS question, 'en' AS task FROM benchmark WHERE item_id % 5 <> 4"


def _appended_log(spark: SparkSession, folder: str) -> str:
    """Log tables appended in two rounds."""
    target = scratch_folder(spark, "log-tables")
    queries, scores = logs.log_tables(spark, folder)
    for part in (0, 1):
        own = F.col("query_log_id").cast("bigint") % 2 == part
        append_log(queries.filter(own), scores.filter(own), target)
    return target


def log_tables_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return logs.shown(run_rows(spark, tables=_appended_log(spark, folder)), "data_source")


LOG_TABLES_ROUND_TRIP = f"WITH {logs.TABLE_ROWS_SQL} SELECT {logs.SHOWN_SQL}, 'tables' AS data_source FROM run_rows"


def log_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return logs.shown(run_rows(spark, lines=logs.written_log(spark, folder)), "data_source")


LOG_LINES_ROUND_TRIP = f"WITH {logs.LOG_ROWS_SQL} SELECT {logs.SHOWN_SQL}, 'log lines' AS data_source FROM log_rows"


def cleared_history(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both log tables before and after they are emptied."""
    target = _appended_log(spark, folder)

    def counted(name: str) -> DataFrame:
        return spark.read.parquet(f"{target}/{name}").agg(F.count("*").alias("n"))

    names = ("query_logs", "evaluations")
    before = {name: counted(name).first()["n"] for name in names}
    clear_log(spark, target)
    left, right = (
        counted(name).select(F.lit(name).alias("name"), F.lit(before[name]).cast("bigint").alias("rows_before"), F.col("n").alias("rows_after"))
        for name in names
    )
    return left.unionByName(right)


CLEARED_HISTORY = """SELECT 'query_logs' AS name, count(*) AS rows_before, 0::BIGINT AS rows_after FROM events
UNION ALL SELECT 'evaluations', count(*) FILTER (event_id % 3 <> 0), 0 FROM events"""


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of forward and reversed lists written to files and compared from there."""
    asked, vectors = retrieval.label_centroids(spark, folder), retrieval.stored_vectors(spark, folder)
    relevant = vectors.select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("query_id"), "chunk_id")
    depth = max(evaluation.K_VALUES)
    found = retrieval.dense_topk(asked, vectors, depth)
    target = scratch_folder(spark, "reports")
    for name, lists in (("forward", found), ("reversed", found.withColumn("rank", F.lit(depth + 1) - F.col("rank")))):
        measured = sample_metrics(asked.select("query_id"), lists, relevant, evaluation.K_VALUES)
        config = {"experiment_id": "e1", "retrieval_mode": "dense", "reranker_type": name, "dataset_generation_method": "labels"}
        write_report(*report_tables(measured, config, evaluation.K_VALUES), target, name)
    compared = compare_report_files(spark, f"{target}/*/summary", "e1", evaluation.COMPARED)
    return compared.select(
        "experiment_id", "dataset_generation_method", "retrieval_mode", "reranker_type", "n_samples",
        *[F.round(F.col(f"`{m}`"), evaluation.DIGITS).alias(evaluation.plain_name(m)) for m in evaluation.COMPARED],
    )


REPORT_FILES = f"SELECT * EXCLUDE (file) FROM ({evaluation.REPORT_COMPARE})"


def _letter_model():
    """A model of two numbers: how many letters a and e a text has."""

    def run(texts: list[str]) -> np.ndarray:
        return np.array([[text.count("a"), text.count("e")] for text in texts], dtype=np.float32)

    return run


def embedding_by_model(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    embedded = plain_chunks(inputs.documents(spark, folder)).withColumn("v", model_embedding(F.col("content"), _letter_model))
    return embedded.select("chunk_id", *[F.get("v", F.lit(at)).cast("int").alias(name) for at, name in enumerate(("n_a", "n_e"))])


EMBEDDING_BY_MODEL = f"""WITH {CHUNKS_SQL}
SELECT chunk_id, (length(content) - length(replace(content, 'a', '')))::INT AS n_a, (length(content) - length(replace(content, 'e', '')))::INT AS n_e FROM chunks"""


def checked_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Per task what a check against the active configuration finds: none, fits, differs or several.

    Tasks without a fault then pass ``validate_configs``, and the others are refused by it.
    """
    first, other = embedding_config("deterministic", "local", 64), embedding_config("remote", "other", 1024)
    config = (
        F.when(F.col("task") == "en", first).when(F.col("task") == "fr", other)
        .when(F.col("task") == "de", F.when(F.col("document_id") % 2 == 0, first).otherwise(other))
    )
    docs = inputs.documents(spark, folder).withColumn("embedding_config", config)
    active = {"provider": "deterministic", "model": "local", "dimensions": 64}
    outcomes = stored(config_outcomes(docs, active), "config-outcomes")
    good = F.col("outcome").isin("none", "fits")
    validate_configs(docs, outcomes.filter(good), active)
    refused = False
    try:
        validate_configs(docs, outcomes.filter(~good), active)
    except EmbeddingConfigMismatch:
        refused = True
    return outcomes.withColumn("refused", ~good & F.lit(refused))


CONFIG_OUTCOMES = f"""WITH {DOCUMENTS_SQL},
found AS (SELECT DISTINCT task, CASE WHEN task = 'en' OR (task = 'de' AND document_id % 2 = 0) THEN 1 ELSE 2 END AS config FROM docs WHERE task <> 'es')
SELECT task, CASE WHEN count(config) = 0 THEN 'none' WHEN count(config) > 1 THEN 'several' WHEN min(config) = 1 THEN 'fits' ELSE 'differs' END AS outcome,
  coalesce(count(config) > 1 OR min(config) = 2, false) AS refused
FROM (SELECT DISTINCT task FROM docs) LEFT JOIN found USING (task) GROUP BY task"""


def builder_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Odd items ask a task with a builder of its own, even ones any other task."""
    asked = inputs.table(spark, folder, "benchmark").select(
        "item_id", retrieval.worded(F.col("text")).alias("question"), F.when(F.col("item_id") % 2 == 1, "legal_qa").otherwise("en").alias("task")
    )
    built = build_lexical_query(F.col("question"), F.col("task"), {"legal_qa": legal_query})
    return asked.select(F.col("item_id").cast("string").alias("query_id"), built.alias("q")).select(
        "query_id", "q.tsquery_text", "q.match_text", "q.article_number", "q.clause_number"
    )


BUILDER_DISPATCH = f"""SELECT * FROM ({retrieval.LEXICAL_QUERY_DOMAIN}) AS d WHERE query_id::BIGINT % 2 = 1
UNION ALL BY NAME SELECT * FROM ({retrieval.LEXICAL_QUERY_DEFAULT}) AS g WHERE query_id::BIGINT % 2 = 0"""


def pooling_records(spark: SparkSession, folder: str) -> DataFrame:
    """What samples record about a pool of dense and both lexical searches."""
    searches = pool_sources(("dense", "lexical"), lexical_backends("mixed"))
    judged = _samples(spark, folder).withColumn("candidates_judged", F.col("relevant_chunk_ids")).withColumn(
        "judged_relevant", F.when(F.col("sample_pos") % 2 == 0, F.col("relevant_chunk_ids")).otherwise(F.array().cast("array<string>"))
    )
    backends = [backend for _, backend in searches if backend]
    recorded = pooling_record(judged, "local", "judge", 10, sorted({mode for mode, _ in searches}), backends)
    return recorded.select(
        "sample_pos", F.col("metadata")["relevance_pooling"].alias("record"), F.col("metadata")["lang"].alias("lang"), F.lit(len(searches)).alias("searches")
    )


POOLING_RECORDS = f"""WITH {DOCUMENTS_SQL}
SELECT document_id AS sample_pos, task AS lang, 3 AS searches,
  '{{"judge_provider":"local","judge_model":"judge","pool_top_k":10,"pool_retrieval_modes":["dense","lexical"],"pool_lexical_backends":["fts","bm25"],'
  || '"candidates_judged":["' || source_path || '"],"judged_relevant":[' || CASE WHEN document_id % 2 = 0 THEN '"' || source_path || '"' ELSE '' END || ']}}' AS record
FROM docs"""

def _replaced_store(spark: SparkSession, folder: str) -> str:
    """A corpus with term tables whose labelled documents have been replaced by a second version."""
    docs, labels = inputs.documents(spark, folder), inputs.table(spark, folder, "labels")
    store = scratch_folder(spark, "store")
    write_corpus(docs.drop("content"), plain_chunks(docs), store, buckets=4, terms=8)
    again = docs.join(labels, F.col("doc_id") == F.col("document_id")).select(*docs.columns).withColumn(
        "content", F.concat(F.lit("Version 2\n"), F.col("content"))
    )
    replace_in_store(spark, store, again.drop("content"), plain_chunks(again))
    return store


def stored_term_search(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over the stored postings of a base and of a segment that replaced the labelled documents."""
    asked = retrieval.lexical_queries(inputs.questions(spark, folder))
    posted, statistics = read_term_tables(spark, _replaced_store(spark, folder), asked.select(F.explode("terms").alias("term")))
    return retrieval.result(bm25_topk(asked, posted, statistics, retrieval.TOP_K))


def bounded_term_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows from blocks that can reach a query's bar."""
    asked = retrieval.lexical_queries(inputs.questions(spark, folder))
    return retrieval.result(bounded_bm25(asked, spark, _replaced_store(spark, folder), retrieval.TOP_K).found)


STORED_TERM_SEARCH = f"""WITH {DOCUMENTS_SQL},
merged AS (
  SELECT d.* REPLACE (CASE WHEN l.doc_id IS NULL THEN content ELSE 'Version 2' || chr(10) || content END AS content)
  FROM docs d LEFT JOIN labels l ON l.doc_id = document_id
),{cut_sql("merged", "content", 800, 100, "cut")},
chunks AS (SELECT source_path || '::chunk::' || piece_no AS chunk_id, task, piece AS content FROM cut),
{QUESTIONS_SQL},{retrieval.terms_sql("questions")},{retrieval.postings_sql()},{retrieval.BM25_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25_ranked WHERE rank <= {retrieval.TOP_K}"""

QUERIES = {
    "bounded_term_search": (bounded_term_search, STORED_TERM_SEARCH),
    "stored_term_search": (stored_term_search, STORED_TERM_SEARCH),
    "text_folder_scan": (text_folder_scan, TEXT_FOLDER_SCAN),
    "document_lookup": (document_lookup, DOCUMENT_LOOKUP),
    "dataset_round_trip": (dataset_round_trip, DATASET_ROUND_TRIP),
    "question_list": (question_list, QUESTION_LIST),
    "log_tables_round_trip": (log_tables_round_trip, LOG_TABLES_ROUND_TRIP),
    "log_lines_round_trip": (log_lines_round_trip, LOG_LINES_ROUND_TRIP),
    "cleared_history": (cleared_history, CLEARED_HISTORY),
    "report_files": (report_files, REPORT_FILES),
    "embedding_by_model": (embedding_by_model, EMBEDDING_BY_MODEL),
    "config_outcomes": (checked_configs, CONFIG_OUTCOMES),
    "builder_dispatch": (builder_dispatch, BUILDER_DISPATCH),
    "pooling_records": (pooling_records, POOLING_RECORDS),
}
