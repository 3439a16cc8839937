"""Queries of the corpus build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.embedding import embedding_config, hash_embedding
from corpusmill.functions.legal import (
    articles, clauses, legal_units, location_display, normalize_legal_text,
    reference_display,
)
from corpusmill.functions.line_repair import repair_lines
from corpusmill.operators.corpus import (
    assemble_pages, chunk_pages, corpus_scan, legal_document_chunks, plain_chunks, replace_documents,
)
from corpusmill.operators.embed import stored_configs
from corpusmill.plans.catalog import inputs
from corpusmill.plans.catalog.inputs import (
    CHUNKS_SQL, DOCUMENTS_SQL, LEGAL_ARTICLES_SQL, LEGAL_CHUNKS_SQL, LEGAL_DOCUMENTS_SQL, cut_sql,
)
from corpusmill.session import stored


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    chunks = plain_chunks(inputs.documents(spark, folder))
    return chunks.select("chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                         F.col("token_count").cast("bigint").alias("token_count"), "content")


CHUNK_FIXED = f"""WITH {CHUNKS_SQL}
SELECT chunk_id, chunk_index, len(regexp_extract_all(content, '\\S+'))::BIGINT AS token_count, content
FROM chunks"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document as one page."""
    return inputs.documents(spark, folder).select(
        "source_path", F.posexplode(F.split("content", "\n")).alias("page_no", "text")
    )


def page_assemble(spark: SparkSession, folder: str) -> DataFrame:
    return assemble_pages(_pages(spark, folder))


def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_pages(_pages(spark, folder)).select(
        "chunk_id", F.col("token_count").cast("bigint").alias("token_count"), "content"
    )


# The repair rule as SQL: the number of tokens that join at each place, then one regex pass.
_REPAIR_SQL = """
tok AS (
  SELECT id, pos, page_text,
    list_transform(list_filter(regexp_split_to_array(page_text, '\\s+'), lambda t: t <> ''), lambda t:
      {'raw': t, 'bare': regexp_replace(t, '^[^A-Za-z]+|[^A-Za-z-]+$', '', 'g')}) AS tokens
  FROM raw_lines
),
described AS (
  SELECT id, pos, list_transform(tokens, lambda t: {'raw': t.raw, 'n': length(t.bare),
    'whole': list_contains(['a','an','and','are','as','at','be','by','do','for','he','if','in','is','it','of','on',
      'or','that','the','these','this','those','to','us','was','we','were','when','with'], lower(t.bare)),
    'is_or': lower(t.bare) = 'or', 'hyphen': ends_with(t.bare, '-')}) AS tokens
  FROM tok
),
repaired AS (
  SELECT id, pos, substring(regexp_replace(array_to_string(list_transform(tokens, lambda a, i:
    chr(10) || CASE
      WHEN i + 2 <= len(tokens) AND a.n > 0 AND tokens[i+1].n > 0 AND tokens[i+2].n > 0 AND NOT a.whole
        AND ((a.n BETWEEN 2 AND 4 AND tokens[i+1].n <= 2 AND tokens[i+2].n >= 4
              AND (NOT tokens[i+1].whole OR tokens[i+1].is_or))
          OR (a.n >= 4 AND tokens[i+1].n >= 4 AND tokens[i+2].n <= 2 AND NOT tokens[i+2].whole)) THEN '3'
      WHEN i + 1 <= len(tokens) AND a.n > 0 AND tokens[i+1].n > 0 AND NOT a.whole AND NOT tokens[i+1].whole
        AND (a.hyphen OR (a.n <= 3 AND tokens[i+1].n >= 4) OR (a.n >= 4 AND tokens[i+1].n <= 2)) THEN '2'
      ELSE '1' END || a.raw), ''),
    '\\n3([^\\n]*)\\n.([^\\n]*)\\n.([^\\n]*)|\\n2([^\\n]*)\\n.([^\\n]*)|\\n1([^\\n]*)',
    ' \\1\\2\\3\\4\\5\\6', 'g'), 2) AS line
  FROM described
)"""

_PAGES_SQL = f"""{DOCUMENTS_SQL},
raw_lines AS (
  SELECT source_path AS id, unnest(string_split(content, chr(10))) AS page_text,
         generate_subscripts(string_split(content, chr(10)), 1) AS pos
  FROM docs
),{_REPAIR_SQL},
assembled AS (
  SELECT id AS source_path,
    coalesce(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE line <> ''), '') AS content,
    count(*) AS page_count
  FROM repaired GROUP BY id
)"""

PAGE_ASSEMBLE = f"""WITH {_PAGES_SQL}
SELECT source_path, content, page_count, regexp_extract(source_path, '([^/]*)$', 1) AS title FROM assembled"""

PAGE_CHUNKS = f"""WITH {_PAGES_SQL},{cut_sql("assembled", "content", 800, 100, "cut")}
SELECT source_path || '::chunk::' || piece_no AS chunk_id,
  len(regexp_extract_all(piece, '\\S+'))::BIGINT AS token_count, piece AS content FROM cut"""


def line_repair(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.documents(spark, folder).select(
        "document_id", repair_lines(F.col("content")).alias("content")
    )


LINE_REPAIR = f"""WITH {DOCUMENTS_SQL},
raw_lines AS (
  SELECT document_id AS id, unnest(string_split(content, chr(10))) AS page_text,
         generate_subscripts(string_split(content, chr(10)), 1) AS pos
  FROM (SELECT document_id, regexp_replace(content, '\\n$', '') AS content FROM docs)
),{_REPAIR_SQL}
SELECT id AS document_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM repaired GROUP BY id"""


def corpus_scan_task(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    chunks = plain_chunks(docs.select("document_id", "source_path", "content"))
    scanned = corpus_scan(docs.select("document_id", "task", "title"), chunks, "en")
    return scanned.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "title",
                          "chunk_id").orderBy("document_id", "chunk_index")


CORPUS_SCAN_TASK = f"""WITH {CHUNKS_SQL}
SELECT document_id, chunk_index, title, chunk_id FROM chunks WHERE task = 'en' ORDER BY 1, 2"""


def corpus_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label arrive anew with a first line; those marked toxic come without text."""
    docs = inputs.documents(spark, folder)
    labels = inputs.table(spark, folder, "labels")
    arriving = docs.join(labels, F.col("document_id") == F.col("doc_id")).withColumn(
        "content", F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("Revised\n"), "content"))
    )
    old = plain_chunks(docs)
    new = plain_chunks(arriving.select(*docs.columns))
    return replace_documents(old, new, arriving).select("chunk_id", "content")


CORPUS_REPLACE = f"""WITH {DOCUMENTS_SQL},
merged AS (
  SELECT source_path, CASE WHEN l.doc_id IS NULL THEN content WHEN l.toxic = 1 THEN '' ELSE 'Revised' || chr(10) || content END AS content
  FROM docs LEFT JOIN labels l ON l.doc_id = document_id
),{cut_sql("merged", "content", 800, 100, "cut")}
SELECT source_path || '::chunk::' || piece_no AS chunk_id, piece AS content FROM cut"""


def legal_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.legal_documents(spark, folder).select(
        "document_id", normalize_legal_text(F.col("content")).alias("content")
    )


LEGAL_NORMALIZE = f"WITH {LEGAL_DOCUMENTS_SQL} SELECT document_id, content FROM legal_norm"


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    normalized = legal_normalize(spark, folder)
    return normalized.select(
        "document_id", F.posexplode(articles(F.col("content"))).alias("article_no", "article")
    ).select("document_id", "article_no", "article.*")


def legal_articles(spark: SparkSession, folder: str) -> DataFrame:
    return _articles(spark, folder).select("document_id", "number", "heading", "title", "body")


LEGAL_ARTICLES = f"""WITH {LEGAL_ARTICLES_SQL}
SELECT document_id, number, heading, title, body FROM (
  SELECT document_id, art, any_value(number) AS number, any_value(heading) AS heading,
    any_value(title) AS title, string_agg(line, chr(10) ORDER BY nth) AS body
  FROM legal_body GROUP BY document_id, art)"""


def legal_clauses(spark: SparkSession, folder: str) -> DataFrame:
    found = _articles(spark, folder).select(
        "document_id", F.col("number").alias("article_number"), F.explode(clauses(F.col("body"))).alias("clause")
    )
    return found.select("document_id", "article_number", F.col("clause.number").alias("clause_number"), "clause.text")


LEGAL_CLAUSES = f"""WITH {LEGAL_ARTICLES_SQL}
SELECT document_id, number AS article_number, clause_number, body AS text FROM legal_units
WHERE clause_number IS NOT NULL"""


def legal_chunks_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the woven legal text as the ingest job cuts them."""
    return legal_document_chunks(inputs.legal_documents(spark, folder), 1400, 200)


def stored_legal_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same as the stored table that searches and benchmark building start from."""
    return stored(legal_chunks_frame(spark, folder), "legal-chunks")


def legal_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return legal_chunks_frame(spark, folder).select(
        "chunk_id", F.col("token_count").cast("bigint").alias("token_count"), "content",
        "metadata.article_number", "metadata.article_title",
        F.coalesce(location_display(F.col("metadata.article_number"), F.col("metadata.clause_number")), F.lit("")).alias("location"),
    )


LEGAL_CHUNKS = f"""WITH {LEGAL_CHUNKS_SQL}
SELECT chunk_id, len(regexp_extract_all(content, '\\S+'))::BIGINT AS token_count, content, article_number, article_title,
  CASE WHEN article_number IS NULL THEN '' ELSE 'Article ' || article_number
    || CASE WHEN len(clause_number) > 0 THEN ' | Clause ' || clause_number[1] ELSE '' END END AS location
FROM legal_chunks"""


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return legal_normalize(spark, folder).select(
        "document_id", F.posexplode(legal_units(F.col("content"))).alias("unit_no", "unit")
    )


def hierarchy_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select(
        "document_id", F.col("unit_no").cast("bigint").alias("unit_no"),
        F.array_join("unit.hierarchy_labels", ";").alias("labels"),
    )


HIERARCHY_LABELS = f"""WITH {LEGAL_ARTICLES_SQL}
SELECT document_id, unit_no - 1 AS unit_no, 'article:' || number
  || CASE WHEN title <> '' THEN ';article_title:' || title ELSE '' END
  || CASE WHEN clause_number IS NOT NULL THEN ';clause:' || clause_number ELSE '' END AS labels
FROM legal_units"""


def cross_reference_list(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select(
        "document_id", F.col("unit_no").cast("bigint").alias("unit_no"),
        F.array_join(reference_display(F.col("unit.cross_references")), "; ").alias("refs"),
    )


CROSS_REFERENCES = f"""WITH {LEGAL_ARTICLES_SQL},
found AS (
  SELECT document_id, unit_no, number, clause_number, 1 AS pass, unnest(list_transform(
      regexp_extract_all(body, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\s+of\\s+Articles?\\s+(\\d+[A-Za-z]?)\\b', 2),
      lambda article, i: {{'a': article, 'c':
        regexp_extract_all(body, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\s+of\\s+Articles?\\s+(\\d+[A-Za-z]?)\\b', 1)[i]}})) AS hit,
    generate_subscripts(regexp_extract_all(body, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\s+of\\s+Articles?\\s+(\\d+[A-Za-z]?)\\b', 1), 1) AS pos
  FROM legal_units
  UNION ALL
  SELECT document_id, unit_no, number, clause_number, 2, {{'a': h, 'c': NULL}}, pos FROM (
    SELECT *, unnest(regexp_extract_all(body, '(?i)\\bArticles?\\s+(\\d+[A-Za-z]?)\\b', 1)) AS h,
      generate_subscripts(regexp_extract_all(body, '(?i)\\bArticles?\\s+(\\d+[A-Za-z]?)\\b', 1), 1) AS pos
    FROM legal_units)
  UNION ALL
  SELECT document_id, unit_no, number, clause_number, 3, {{'a': number, 'c': h}}, pos FROM (
    SELECT *, unnest(regexp_extract_all(body, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\s+of\\s+(?:this|the)\\s+Article\\b', 1)) AS h,
      generate_subscripts(regexp_extract_all(body, '(?i)\\b(?:clause|paragraph)\\s+(\\d+)\\s+of\\s+(?:this|the)\\s+Article\\b', 1), 1) AS pos
    FROM legal_units)
),
kept AS (
  SELECT document_id, unit_no, pass, pos, hit.a AS a, CAST(hit.c AS BIGINT) AS c,
    row_number() OVER (PARTITION BY document_id, unit_no, hit.a, CAST(hit.c AS BIGINT) ORDER BY pass, pos) AS nth
  FROM found
  WHERE CASE pass
    WHEN 1 THEN NOT (hit.a = number AND coalesce(CAST(hit.c AS BIGINT) = clause_number, false))
    WHEN 2 THEN hit.a <> number
    ELSE coalesce(CAST(hit.c AS BIGINT) <> clause_number, true) END
)
SELECT u.document_id, u.unit_no - 1 AS unit_no, coalesce(string_agg(
    'Article ' || a || CASE WHEN c IS NOT NULL THEN ', Clause ' || c ELSE '' END
    || CASE WHEN pass = 3 THEN ' (same article)' ELSE '' END, '; ' ORDER BY pass, pos), '') AS refs
FROM legal_units u LEFT JOIN kept k ON k.document_id = u.document_id AND k.unit_no = u.unit_no AND k.nth = 1
GROUP BY 1, 2"""


def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    chunks = plain_chunks(inputs.documents(spark, folder))
    vector = hash_embedding(F.col("content"), 64)
    return chunks.select("chunk_id", vector.alias("v")).select(
        "chunk_id",
        F.array_join(F.transform("v", lambda x: F.round((x + 1) * 127.5).cast("int").cast("string")), ",").alias("bytes"),
    )


HASH_EMBEDDING = f"""WITH {CHUNKS_SQL}
SELECT chunk_id, array_to_string(list_transform(range(64), lambda i:
    ('0x' || substring(sha256('0:' || content) || sha256('1:' || content), CAST(2 * i + 1 AS BIGINT), 2))::INT), ',') AS bytes
FROM chunks"""


def embedding_config_check(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct configurations per task when every document records the one it was embedded with."""
    docs = inputs.documents(spark, folder).withColumn(
        "embedding_config",
        F.when(F.col("document_id") % 5 != 0, F.when(
            (F.col("task") == "de") & (F.col("document_id") % 2 == 0), embedding_config("remote", "other", 1024)
        ).otherwise(embedding_config("deterministic", "deterministic-local", 64))),
    )
    found = stored_configs(docs)
    return found.select("task", "provider", "model", F.col("dimensions").cast("bigint").alias("dimensions"))


EMBEDDING_CONFIG_CHECK = f"""WITH {DOCUMENTS_SQL}
SELECT DISTINCT task,
  CASE WHEN task = 'de' AND document_id % 2 = 0 THEN 'remote' ELSE 'deterministic' END AS provider,
  CASE WHEN task = 'de' AND document_id % 2 = 0 THEN 'other' ELSE 'deterministic-local' END AS model,
  CASE WHEN task = 'de' AND document_id % 2 = 0 THEN 1024 ELSE 64 END::BIGINT AS dimensions
FROM docs WHERE document_id % 5 <> 0"""

QUERIES = {
    "chunk_fixed": (chunk_fixed, CHUNK_FIXED),
    "page_assemble": (page_assemble, PAGE_ASSEMBLE),
    "page_chunks": (page_chunks, PAGE_CHUNKS),
    "line_repair": (line_repair, LINE_REPAIR),
    "corpus_scan_task": (corpus_scan_task, CORPUS_SCAN_TASK),
    "corpus_replace": (corpus_replace, CORPUS_REPLACE),
    "legal_normalize": (legal_normalize, LEGAL_NORMALIZE),
    "legal_articles": (legal_articles, LEGAL_ARTICLES),
    "legal_clauses": (legal_clauses, LEGAL_CLAUSES),
    "legal_chunks": (legal_chunks, LEGAL_CHUNKS),
    "hierarchy_labels": (hierarchy_labels, HIERARCHY_LABELS),
    "cross_references": (cross_reference_list, CROSS_REFERENCES),
    "hash_embedding": (hash_embeddings, HASH_EMBEDDING),
    "embedding_config_check": (embedding_config_check, EMBEDDING_CONFIG_CHECK),
}
