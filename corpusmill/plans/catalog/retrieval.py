"""Queries of lexical, dense and fused retrieval and of reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.embedding import hash_embedding
from corpusmill.functions.lexical_query import general_query, legal_query
from corpusmill.operators.corpus import plain_chunks
from corpusmill.operators.dense import dense_topk
from corpusmill.operators.lexical_index import analyzed, term_statistics, tokens, vocabulary
from corpusmill.operators.lexical_search import bm25_topk, filter_only_topk, fts_topk
from corpusmill.operators.rerank import rerank
from corpusmill.operators.retrieve import RetrievalSettings, retrieve, with_chunk_columns
from corpusmill.plans.catalog import inputs
from corpusmill.plans.catalog.stem_sql import stems_sql
from corpusmill.plans.catalog.corpus import legal_chunks_frame
from corpusmill.plans.catalog.inputs import CHUNKS_SQL, LEGAL_CHUNKS_SQL, QUESTIONS_SQL
from corpusmill.session import stored

TOP_K = 4
VECTOR_SIZE = 64


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return plain_chunks(inputs.documents(spark, folder))


def lexical_queries(asked: DataFrame) -> DataFrame:
    """Questions with the terms and filters of the general builder."""
    return asked.withColumn("q", general_query(F.col("question"))).select(
        "query_id", "task", "question", "q.terms", "q.article_number", "q.clause_number"
    )


def terms_sql(source: str, name: str = "asked_terms") -> str:
    """The general builder in SQL over ``source(query_id, task, question)``."""
    return f"""
{name}_words AS (
  SELECT query_id, task, question,
    nullif(regexp_extract(question, '(?i)\\barticle\\s+(\\d+)\\b', 1), '') AS article_number,
    nullif(regexp_extract(question, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\b', 1), '') AS clause_number,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(
        lower(question), '\\barticle\\s+\\d+\\b', ' ', 'g'), '\\b(?:clause|paragraph)\\s+\\d+\\b', ' ', 'g'),
        '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda t: trim(t, '-')),
      lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains(['a','an','and','are','article',
        'by','clause','does','how','is','of','paragraph','the','to','what','when','who'], t)) AS words
  FROM {source}
),
{name} AS (
  SELECT query_id, task, question, article_number, clause_number,
    list_filter(words, lambda t, i: list_position(words, t) = i) AS terms
  FROM {name}_words
)"""


def worded(folder_question: Column) -> Column:
    """Benchmark text with article and clause mentions of several kinds."""
    item = F.col("item_id")
    return (
        F.when(item % 4 == 0, F.concat(folder_question, F.lit(" according to Article 12?")))
        .when(item % 4 == 1, F.concat(F.lit("What is said in paragraph 3 of article 5a on "), folder_question))
        .when(item % 4 == 2, F.concat(F.lit("How does this Regulation, under Article 7, Clause 2, see "), folder_question))
        .otherwise(folder_question)
    )


WORDED_SQL = """
worded AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, 'en' AS task, CASE item_id % 4
    WHEN 0 THEN text || ' according to Article 12?'
    WHEN 1 THEN 'What is said in paragraph 3 of article 5a on ' || text
    WHEN 2 THEN 'How does this Regulation, under Article 7, Clause 2, see ' || text
    ELSE text END AS question
  FROM benchmark
)"""


def lexical_query_default(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.table(spark, folder, "benchmark").select("item_id", worded(F.col("text")).alias("question"))
    return asked.select(F.col("item_id").cast("string").alias("query_id"), general_query(F.col("question")).alias("q")).select(
        "query_id", "q.tsquery_text", "q.match_text", "q.article_number", "q.clause_number"
    )


LEXICAL_QUERY_DEFAULT = f"""WITH {WORDED_SQL},{terms_sql("worded")}
SELECT query_id, nullif(array_to_string(terms, ' | '), '') AS tsquery_text,
  nullif(array_to_string(terms, ' '), '') AS match_text, article_number, clause_number FROM asked_terms"""


def lexical_query_domain(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.table(spark, folder, "benchmark").select("item_id", worded(F.col("text")).alias("question"))
    return asked.select(F.col("item_id").cast("string").alias("query_id"), legal_query(F.col("question")).alias("q")).select(
        "query_id", "q.tsquery_text", "q.match_text", "q.article_number", "q.clause_number"
    )


LEXICAL_QUERY_DOMAIN = f"""WITH {WORDED_SQL},
plain AS (
  SELECT query_id, question, regexp_replace(regexp_replace(lower(question),
    '\\b(?:what is|what are|what does|how does|who is|who are|when does|according to|under)\\b', ' ', 'g'),
    '\\b(?:digital services act|this regulation)\\b', ' ', 'g') AS text
  FROM worded
),
words AS (
  SELECT query_id, question, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(
      text, '\\barticle\\s+\\d+\\b', ' ', 'g'), '\\b(?:clause|paragraph)\\s+\\d+\\b', ' ', 'g'),
      '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda t: trim(t, '-')),
    lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains(['a','an','and','article','act','by',
      'clause','digital','does','how','is','of','paragraph','regulation','services','the','this','to','what','who'], t)) AS words
  FROM plain
)
SELECT query_id, nullif(array_to_string(list_filter(words, lambda t, i: list_position(words, t) = i), ' | '), '') AS tsquery_text,
  NULL::VARCHAR AS match_text,
  nullif(regexp_extract(question, '(?i)\\barticle\\s+(\\d+)\\b', 1), '') AS article_number,
  nullif(regexp_extract(question, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\b', 1), '') AS clause_number
FROM words"""


def postings_sql(source: str = "chunks", metadata: bool = False) -> str:
    extra = "article_number, clause_number" if metadata else "NULL::VARCHAR AS article_number, [] AS clause_number"
    return f"""
tokenized AS (
  SELECT chunk_id, task, {extra}, list_filter(
    regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS toks
  FROM {source}
),
posted AS (
  SELECT chunk_id, task, article_number, clause_number, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, task, article_number, clause_number, len(toks) AS dl, unnest(toks) AS term FROM tokenized)
  GROUP BY ALL
)"""


ACCEPTS_SQL = """p.task = q.task AND (q.article_number IS NULL OR q.article_number = p.article_number)
    AND (q.clause_number IS NULL OR list_contains(p.clause_number, CAST(q.clause_number AS BIGINT)))"""

BM25_SQL = f"""
corpus AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS mean_length FROM tokenized),
document_frequency AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
query_terms AS (SELECT query_id, task, article_number, clause_number, unnest(terms) AS term FROM asked_terms),
bm25_scored AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_length))), 10) AS score
  FROM query_terms q JOIN posted p ON p.term = q.term AND {ACCEPTS_SQL}
    JOIN document_frequency d ON d.term = q.term CROSS JOIN corpus
  GROUP BY 1, 2
),
bm25_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25_scored
)"""

FTS_STOP_SQL = "string_split('i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now', ' ')"

FTS_SQL = f"""
fts_terms AS (
  SELECT DISTINCT query_id, task, article_number, clause_number, word AS term
  FROM (SELECT *, unnest(string_split(term, '-')) AS word FROM (
    SELECT query_id, task, article_number, clause_number, unnest(terms) AS term FROM asked_terms))
  WHERE word <> '' AND NOT list_contains({FTS_STOP_SQL}, word)
),
fts_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, sum(tf) / 10.0::DOUBLE AS score
    FROM fts_terms q JOIN posted p ON p.term = q.term AND {ACCEPTS_SQL} GROUP BY 1, 2)
)"""


def result(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def bm25_query(spark: SparkSession, folder: str) -> DataFrame:
    corpus, asked = chunks(spark, folder), lexical_queries(inputs.questions(spark, folder))
    statistics = term_statistics(corpus, asked.select(F.explode("terms").alias("term")))
    return result(bm25_topk(asked, analyzed(corpus), statistics, TOP_K))


BM25_TOPK = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{terms_sql("questions")},{postings_sql()},{BM25_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25_ranked WHERE rank <= {TOP_K}"""


def _fts(spark: SparkSession, folder: str, stemming: bool) -> DataFrame:
    corpus, asked = chunks(spark, folder), lexical_queries(inputs.questions(spark, folder))
    return result(fts_topk(asked, analyzed(corpus), TOP_K, stemming=stemming, vocabulary=vocabulary(corpus)))


def fts_query(spark: SparkSession, folder: str) -> DataFrame:
    return _fts(spark, folder, stemming=False)


def fts_stemmed_query(spark: SparkSession, folder: str) -> DataFrame:
    return _fts(spark, folder, stemming=True)


FTS_TOPK = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{terms_sql("questions")},{postings_sql()},{FTS_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fts_ranked WHERE rank <= {TOP_K}"""


_STEMMED_SQL = FTS_SQL.replace("fts_terms", "fts_words", 1).replace("fts_ranked AS", """fts_terms AS (
  SELECT DISTINCT q.query_id, q.task, q.article_number, q.clause_number, v.term
  FROM fts_words q JOIN stems s ON s.term = q.term JOIN stems v ON v.stem = s.stem
  WHERE NOT list_contains(""" + FTS_STOP_SQL + """, v.term)
),
fts_ranked AS""", 1)
_WORDS_SQL = """SELECT term FROM posted UNION SELECT unnest(string_split(term, '-')) FROM (SELECT unnest(terms) AS term FROM asked_terms)"""
FTS_TOPK_STEMMED = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{terms_sql("questions")},{postings_sql()},{stems_sql(_WORDS_SQL)},{_STEMMED_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fts_ranked WHERE rank <= {TOP_K}"""


def _placed_questions(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    """Questions that name an article, every other one also a clause; optionally without other words."""
    asked = inputs.questions(spark, folder)
    article = (F.col("item_id") % 97 + 1).cast("string")
    place = F.concat(
        F.lit("What is Article "), article,
        F.when(F.col("item_id") % 2 == 1, F.concat(F.lit(", Clause "), (F.col("item_id") % 3 + 1).cast("string"))).otherwise(""),
    )
    worded = F.concat_ws(" ", place, F.col("question")) if with_text else (
        F.when(F.col("item_id") % 5 == 4, F.lit("Who is a?")).otherwise(place)
    )
    return asked.withColumn("question", worded)


PLACED_SQL = """
placed AS (
  SELECT query_id, task, item_id, question AS text, 'What is Article ' || (item_id % 97 + 1)
    || CASE WHEN item_id % 2 = 1 THEN ', Clause ' || (item_id % 3 + 1) ELSE '' END AS place
  FROM questions
)"""


def metadata_filter_query(spark: SparkSession, folder: str) -> DataFrame:
    corpus = stored(analyzed(legal_chunks_frame(spark, folder)), "analyzed-chunks")
    asked = lexical_queries(_placed_questions(spark, folder, with_text=True))
    statistics = term_statistics(corpus, asked.select(F.explode("terms").alias("term")))
    return result(bm25_topk(asked, corpus, statistics, TOP_K))


METADATA_FILTER = f"""WITH {LEGAL_CHUNKS_SQL},{QUESTIONS_SQL},{PLACED_SQL},
asked AS (SELECT query_id, task, place || ' ' || text AS question FROM placed),{terms_sql("asked")},{postings_sql("legal_chunks", True)},{BM25_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25_ranked WHERE rank <= {TOP_K}"""


def filter_only_query(spark: SparkSession, folder: str) -> DataFrame:
    asked = lexical_queries(_placed_questions(spark, folder, with_text=False))
    return result(filter_only_topk(asked, legal_chunks_frame(spark, folder), TOP_K))


FILTER_ONLY = f"""WITH {LEGAL_CHUNKS_SQL},{QUESTIONS_SQL},{PLACED_SQL},
asked AS (SELECT query_id, task, CASE WHEN item_id % 5 = 4 THEN 'Who is a?' ELSE place END AS question FROM placed),{terms_sql("asked")},
listed AS (
  SELECT q.query_id, p.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.chunk_index, p.chunk_id) AS rank
  FROM asked_terms q JOIN legal_chunks p ON {ACCEPTS_SQL} WHERE len(q.terms) = 0
)
SELECT query_id, rank, chunk_id, 0.0::DOUBLE AS score FROM listed WHERE rank <= {TOP_K}"""


def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    corpus = chunks(spark, folder)
    return corpus.withColumn("embedding", hash_embedding(F.col("content"), VECTOR_SIZE))


def embedded_questions(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.questions(spark, folder).withColumn("query_vector", hash_embedding(F.col("question"), VECTOR_SIZE))


def _vector_sql(text: str) -> str:
    return f"""list_transform(range({VECTOR_SIZE}), lambda i:
      (('0x' || substring(sha256('0:' || {text}) || sha256('1:' || {text}), CAST(2 * i + 1 AS BIGINT), 2))::INT::DOUBLE
        / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)::FLOAT)::DOUBLE[]"""


DENSE_SQL = f"""
chunk_vectors AS (SELECT chunk_id, task, {_vector_sql("content")} AS v FROM chunks),
question_vectors AS (SELECT query_id, task, {_vector_sql("question")} AS v FROM questions),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(list_cosine_similarity(q.v, c.v), 10) AS score
    FROM question_vectors q JOIN chunk_vectors c ON c.task = q.task)
)"""


def dense_query(spark: SparkSession, folder: str) -> DataFrame:
    return result(dense_topk(embedded_questions(spark, folder), embedded_chunks(spark, folder), TOP_K))


DENSE_TOPK = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{DENSE_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM dense_ranked WHERE rank <= {TOP_K}"""


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label as query; the stored vectors are its corpus."""
    values = inputs.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "value"))
    # The mean is taken in whole micro units, so that it does not depend on the order of adding.
    means = values.groupBy("label", "at").agg(
        F.sum(F.round(F.col("value").cast("double") * 1e6).cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n")
    )
    return means.groupBy("label").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", (F.col("total") / F.col("n") / 1e6).cast("float").alias("mean")))),
            lambda entry: entry["mean"],
        ).alias("query_vector")
    ).select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("query_id"), F.lit("all").alias("task"), "query_vector", "label")


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit("all").alias("task"), "embedding", "label"
    )


CENTROID_SQL = """
centroids AS (
  SELECT label, list(mean ORDER BY pos)::DOUBLE[] AS v FROM (
    SELECT label, pos, (sum(round(value::DOUBLE * 1e6)::BIGINT)::DOUBLE / count(*) / 1e6)::FLOAT AS mean
    FROM (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY 1, 2) GROUP BY label
),
label_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT 'label:' || c.label AS query_id, c.label AS asked_label, e.label, CAST(vec_id AS VARCHAR) AS chunk_id,
      round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 10) AS score
    FROM centroids c CROSS JOIN embeddings e)
)"""


def label_topk(spark: SparkSession, folder: str) -> DataFrame:
    return result(dense_topk(label_centroids(spark, folder), stored_vectors(spark, folder), 10))


LABEL_TOPK = f"""WITH {CENTROID_SQL}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM label_ranked WHERE rank <= 10"""


HYBRID = RetrievalSettings(mode="hybrid", lexical_backend="bm25", stemming=False)


def candidates_result(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"),
        F.round("dense_score", 6).alias("dense_score"), F.round("lexical_score", 6).alias("lexical_score"),
        F.array_join("retrieval_sources", "+").alias("sources"),
    )


def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return candidates_result(retrieve(
        embedded_questions(spark, folder), embedded_chunks(spark, folder), HYBRID, modes=("hybrid",), backends=("bm25",)
    ))


def fused_sql(dense: str, lexical: str) -> str:
    """Fusion of two ranked tables that carry ``pool``, the length they are cut to."""
    return f"""
fused AS (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
    d.score AS dense_score, l.score AS lexical_score,
    coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS fusion_score,
    CASE WHEN d.rank IS NULL THEN 'lexical' WHEN l.rank IS NULL THEN 'dense' ELSE 'dense+lexical' END AS sources,
    row_number() OVER (PARTITION BY coalesce(d.query_id, l.query_id) ORDER BY
      coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) DESC,
      coalesce(d.rank, 1000000000), coalesce(l.rank, 1000000000)) AS rank
  FROM (SELECT * FROM {dense} WHERE rank <= pool) d
    FULL JOIN (SELECT * FROM {lexical} WHERE rank <= pool) l ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id
)"""


RRF_HYBRID = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{DENSE_SQL},{terms_sql("questions")},{postings_sql()},{BM25_SQL},
dense_pool AS (SELECT *, 12 AS pool FROM dense_ranked), bm25_pool AS (SELECT *, 12 AS pool FROM bm25_ranked),{fused_sql("dense_pool", "bm25_pool")}
SELECT query_id, rank, chunk_id, round(fusion_score, 6) AS score, round(dense_score, 6) AS dense_score,
  round(lexical_score, 6) AS lexical_score, sources
FROM fused WHERE rank <= {TOP_K}"""


def mode_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Each question with a mode, backend and length of its own."""
    item = F.col("item_id")
    asked = (
        embedded_questions(spark, folder)
        .withColumn("retrieval_mode", F.when(item % 4 == 0, " Dense").when(item % 4 == 1, "lexical").when(item % 4 == 2, "HYBRID"))
        .withColumn("lexical_backend", F.when(item % 2 == 0, "bm25"))
        .withColumn("top_k", (item % 3 * 8).cast("int"))
    )
    return candidates_result(retrieve(asked, embedded_chunks(spark, folder), RetrievalSettings(stemming=False)))


MODE_DISPATCH = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{DENSE_SQL},{terms_sql("questions")},{postings_sql()},{BM25_SQL},{FTS_SQL},
wishes AS (
  SELECT query_id, CASE item_id % 4 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'hybrid' END AS mode,
    CASE WHEN item_id % 2 = 0 THEN 'bm25' ELSE 'fts' END AS backend,
    CASE item_id % 3 WHEN 0 THEN 4 ELSE item_id % 3 * 8 END AS wanted
  FROM questions
),
dense_pool AS (
  SELECT r.*, CASE w.mode WHEN 'lexical' THEN 0 WHEN 'dense' THEN wanted ELSE greatest(wanted, 12) END AS pool
  FROM dense_ranked r JOIN wishes w ON w.query_id = r.query_id
),
lexical_pool AS (
  SELECT r.*, CASE w.mode WHEN 'dense' THEN 0 WHEN 'lexical' THEN wanted ELSE greatest(wanted, 12) END AS pool
  FROM (SELECT query_id, chunk_id, score, rank, 'bm25' AS backend FROM bm25_ranked
        UNION ALL SELECT query_id, chunk_id, score, rank, 'fts' FROM fts_ranked) r
    JOIN wishes w ON w.query_id = r.query_id AND w.backend = r.backend
),{fused_sql("dense_pool", "lexical_pool")}
SELECT f.query_id, rank, chunk_id, round(CASE WHEN mode = 'hybrid' THEN fusion_score ELSE coalesce(dense_score, lexical_score) END, 6) AS score,
  round(dense_score, 6) AS dense_score, round(lexical_score, 6) AS lexical_score, sources
FROM fused f JOIN wishes w ON w.query_id = f.query_id WHERE rank <= wanted"""


def overlap_score(question: Column, content: Column) -> Column:
    """Stand-in for a cross-encoder: share of the question's distinct words that the content holds."""
    asked = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(asked, tokens(content))) / F.size(asked)


def rerank_query(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 lists of twelve, rescored and cut to four; every third question passes through."""
    corpus = chunks(spark, folder)
    asked = inputs.questions(spark, folder).withColumn(
        "reranker_type", F.when(F.col("item_id") % 3 != 0, "Cross_Encoder ")
    )
    queries = lexical_queries(asked)
    statistics = term_statistics(corpus, queries.select(F.explode("terms").alias("term")))
    found = bm25_topk(queries, analyzed(corpus), statistics, 12)
    with_text = with_chunk_columns(found, corpus, "content")
    ranked = rerank(with_text, asked, overlap_score(F.col("question"), F.col("content")), keep=TOP_K)
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "reranker_type",
        F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"),
    )


RERANK_TOPK = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{terms_sql("questions")},{postings_sql()},{BM25_SQL},
pairs AS (
  SELECT b.query_id, b.chunk_id, b.rank AS first_rank, b.score, q.item_id % 3 <> 0 AS scored,
    list_distinct(list_filter(regexp_split_to_array(lower(q.question), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS words,
    t.toks
  FROM bm25_ranked b JOIN questions q ON q.query_id = b.query_id JOIN tokenized t ON t.chunk_id = b.chunk_id
  WHERE b.rank <= 12
),
rescored AS (
  SELECT *, len(list_intersect(words, toks))::DOUBLE / len(words) AS rerank_score FROM pairs
),
reordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS new_rank FROM rescored
)
SELECT query_id, first_rank AS rank, chunk_id, 'pass_through' AS reranker_type, NULL::DOUBLE AS rerank_score,
  round(score, 6) AS score FROM reordered WHERE NOT scored
UNION ALL
SELECT query_id, new_rank, chunk_id, 'cross_encoder', round(rerank_score, 6), round(score, 6)
FROM reordered WHERE scored AND new_rank <= {TOP_K}"""

QUERIES = {
    "lexical_query_default": (lexical_query_default, LEXICAL_QUERY_DEFAULT),
    "lexical_query_domain": (lexical_query_domain, LEXICAL_QUERY_DOMAIN),
    "bm25_topk": (bm25_query, BM25_TOPK),
    "fts_topk": (fts_query, FTS_TOPK),
    "fts_topk_stemmed": (fts_stemmed_query, FTS_TOPK_STEMMED),
    "metadata_filter_topk": (metadata_filter_query, METADATA_FILTER),
    "filter_only_listing": (filter_only_query, FILTER_ONLY),
    "dense_topk": (dense_query, DENSE_TOPK),
    "label_topk": (label_topk, LABEL_TOPK),
    "rrf_hybrid": (rrf_hybrid, RRF_HYBRID),
    "mode_dispatch": (mode_dispatch, MODE_DISPATCH),
    "rerank_topk": (rerank_query, RERANK_TOPK),
}
