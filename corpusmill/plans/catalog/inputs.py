"""Frames the registered queries start from, and the same as SQL for the check.

Every ``*_SQL`` text is a list of common table expressions without the WITH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File bytes that are worth a task of their own.
BYTES_PER_PIECE = 512 * 1024

TASKS = ("en", "fr", "de", "es")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one of some size that comes in few pieces is spread over as many cores as its bytes are worth."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(spark.sparkContext.defaultParallelism, size // BYTES_PER_PIECE)
    return frame.repartition(wanted, frame.columns[0]) if wanted > frame.rdd.getNumPartitions() else frame


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, task, source_path, title, content."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("task"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT doc_id AS document_id, lang AS task, source || '/' || doc_id AS source_path,
         'Document ' || doc_id AS title, text AS content
  FROM documents
)"""


def cut_sql(source: str, text: str, size: int, overlap: int, name: str) -> str:
    """Fixed-size pieces of ``text``: all columns of ``source`` plus piece_no and piece."""
    step = size - overlap
    return f"""
{name} AS (
  SELECT *, substring({text}, CAST(piece_no * {step} + 1 AS BIGINT), {size}) AS piece
  FROM (
    SELECT *, unnest(range(CASE WHEN length({text}) = 0 THEN 0
      ELSE 1 + greatest(0, CAST(ceil((length({text}) - {size}) / {step}.0) AS BIGINT)) END)) AS piece_no
    FROM {source}
  )
)"""


CHUNKS_SQL = (
    DOCUMENTS_SQL + "," + cut_sql("docs", "content", 800, 100, "cut") + """,
chunks AS (
  SELECT source_path || '::chunk::' || piece_no AS chunk_id, document_id, task, source_path, title,
         piece_no AS chunk_index, piece AS content
  FROM cut
)"""
)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text asked of every task: query_id, item_id, question, task."""
    asked = table(spark, folder, "benchmark")
    tasks = F.explode(F.array(*[F.lit(task) for task in TASKS]))
    return asked.select("item_id", F.col("text").alias("question"), tasks.alias("task")).withColumn(
        "query_id", F.concat_ws(":", F.col("item_id").cast("string"), "task")
    )


QUESTIONS_SQL = """
questions AS (
  SELECT item_id || ':' || task AS query_id, item_id, text AS question, task
  FROM (SELECT *, unnest(['en', 'fr', 'de', 'es']) AS task FROM benchmark)
)"""


def legal_text() -> Column:
    """Document text with headings, titles, clause numbers and references woven in.

    One document in eleven gets no heading, one in seven articles without clauses.
    """
    doc = F.col("document_id")

    def line(words: Column, at: Column) -> Column:
        number = (doc % 97 + 1 + F.floor(at / 3)).cast("string")
        letter = F.when(at % 2 == 1, "a").otherwise("")
        article = F.when(at % 4 == 3, "Ar ticle ").otherwise("Article ")
        title = F.when((doc + at) % 5 != 0, F.concat(F.lit("Heading of part "), at.cast("string"), F.lit(".\n"))).otherwise("")
        heading = F.when(
            (at % 3 == 0) & (doc % 11 != 0), F.concat(article, number, letter, F.lit(" \n"), title)
        ).otherwise("")
        clause = F.when(doc % 7 != 3, F.concat((at % 3 + 1).cast("string"), F.lit(". "))).otherwise("")
        other = (doc % 97 + 2).cast("string")
        reference = (
            F.when(at % 4 == 1, F.concat(F.lit(" See paragraph 2 of Article "), other, F.lit(" and clause 3 of this Article.")))
            .when(at % 4 == 2, F.concat(F.lit(" Articles 5a and article "), number, F.lit(" apply, clause 1 of Article "), number, F.lit(".")))
            .when(at % 4 == 3, " Subject to ar ticle 12 and article 12, TIT LE two.")
            .otherwise(" Paragraph 2 of the Article stays.")
        )
        return F.concat(heading, clause, words, reference)

    body = F.array_join(F.transform(F.split(F.col("content"), "\n"), line), "\n")
    return F.concat(F.lit("Preamble before any heading\n"), body)


def legal_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the woven legal text as content."""
    return documents(spark, folder).withColumn("content", legal_text())


LEGAL_DOCUMENTS_SQL = DOCUMENTS_SQL + """,
legal_docs AS (
  SELECT document_id, task, source_path, title,
    'Preamble before any heading' || chr(10) || array_to_string(list_transform(
      string_split(content, chr(10)), lambda words, i:
        CASE WHEN (i - 1) % 3 = 0 AND document_id % 11 <> 0 THEN
          CASE WHEN (i - 1) % 4 = 3 THEN 'Ar ticle ' ELSE 'Article ' END
          || (document_id % 97 + 1 + (i - 1) // 3) || CASE WHEN (i - 1) % 2 = 1 THEN 'a' ELSE '' END
          || ' ' || chr(10)
          || CASE WHEN (document_id + i - 1) % 5 <> 0 THEN 'Heading of part ' || (i - 1) || '.' || chr(10) ELSE '' END
        ELSE '' END
        || CASE WHEN document_id % 7 <> 3 THEN ((i - 1) % 3 + 1) || '. ' ELSE '' END
        || words
        || CASE (i - 1) % 4
             WHEN 1 THEN ' See paragraph 2 of Article ' || (document_id % 97 + 2) || ' and clause 3 of this Article.'
             WHEN 2 THEN ' Articles 5a and article ' || (document_id % 97 + 1 + (i - 1) // 3)
                         || ' apply, clause 1 of Article ' || (document_id % 97 + 1 + (i - 1) // 3) || '.'
             WHEN 3 THEN ' Subject to ar ticle 12 and article 12, TIT LE two.'
             ELSE ' Paragraph 2 of the Article stays.' END), chr(10)) AS content
  FROM docs
),
legal_norm AS (
  SELECT document_id, task, source_path, title,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      content, '(?i)\\bAr\\s*ticle\\b', 'Article', 'g'), '(?i)\\bCHAP\\s*TER\\b', 'CHAPTER', 'g'),
      '(?i)\\bSEC\\s*TION\\b', 'SECTION', 'g'), '(?i)\\bTIT\\s*LE\\b', 'TITLE', 'g'),
      '[ \\t]+\\n', chr(10), 'g') AS content
  FROM legal_docs
)"""

LEGAL_ARTICLES_SQL = LEGAL_DOCUMENTS_SQL + """,
legal_lines AS (
  SELECT document_id, pos, line,
    sum(CASE WHEN regexp_full_match(line, 'Article\\s+\\d+[A-Za-z]?\\s*') THEN 1 ELSE 0 END)
      OVER (PARTITION BY document_id ORDER BY pos) AS art
  FROM (
    SELECT document_id, unnest(string_split(content, chr(10))) AS line,
           generate_subscripts(string_split(content, chr(10)), 1) AS pos
    FROM legal_norm
  )
),
legal_content AS (
  SELECT document_id, art, line,
         row_number() OVER (PARTITION BY document_id, art ORDER BY pos) AS nth
  FROM (SELECT document_id, art, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM legal_lines)
  WHERE art > 0 AND line <> ''
),
legal_heads AS (
  SELECT document_id, art,
    max(CASE WHEN nth = 1 THEN line END) AS heading,
    max(CASE WHEN nth = 1 THEN regexp_extract(line, '^Article\\s+(\\d+[A-Za-z]?)', 1) END) AS number,
    coalesce(max(CASE WHEN nth = 2 AND NOT regexp_matches(line, '^\\d+\\.\\s') THEN line END), '') AS title,
    coalesce(max(CASE WHEN nth = 2 AND NOT regexp_matches(line, '^\\d+\\.\\s') THEN 3 END), 2) AS first_body
  FROM legal_content GROUP BY ALL
),
legal_body AS (
  SELECT c.document_id, c.art, h.heading, h.number, h.title, c.line, c.nth,
    regexp_matches(c.line, '^\\d+\\.\\s')
      OR (regexp_matches(c.line, '^\\d+\\.$')
          AND lead(c.nth) OVER (PARTITION BY c.document_id, c.art ORDER BY c.nth) IS NOT NULL) AS opens
  FROM legal_content c JOIN legal_heads h ON c.document_id = h.document_id AND c.art = h.art
  WHERE c.nth >= h.first_body
),
legal_marked AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END)
      OVER (PARTITION BY document_id, art ORDER BY nth) AS clause_seq,
    bool_or(opens) OVER (PARTITION BY document_id, art) AS has_clauses
  FROM legal_body
),
legal_units AS (
  SELECT document_id, art, clause_seq, any_value(heading) AS heading, any_value(number) AS number,
    any_value(title) AS title, string_agg(line, chr(10) ORDER BY nth) AS body,
    CASE WHEN any_value(has_clauses)
      THEN CAST(regexp_extract(first(line ORDER BY nth), '^(\\d+)\\.', 1) AS BIGINT) END AS clause_number,
    row_number() OVER (PARTITION BY document_id ORDER BY art, clause_seq) AS unit_no
  FROM legal_marked
  WHERE NOT has_clauses OR clause_seq > 0
  GROUP BY document_id, art, clause_seq
)"""

LEGAL_CHUNKS_SQL = LEGAL_ARTICLES_SQL + """,
legal_texts AS (
  SELECT document_id, unit_no, number, title AS article_title, clause_number, body,
    heading || CASE WHEN title <> '' THEN chr(10) || title ELSE '' END || chr(10) || body AS full_text
  FROM legal_units
  UNION ALL
  SELECT document_id, 0, NULL, NULL, NULL, NULL, content FROM legal_norm
  WHERE document_id NOT IN (SELECT document_id FROM legal_units)
),""" + cut_sql("legal_texts", "full_text", 1400, 200, "legal_cut") + """,
legal_chunks AS (
  SELECT d.source_path || '::chunk::' || p.chunk_index AS chunk_id, d.document_id, d.task, d.source_path,
    d.title, p.chunk_index, p.piece AS content, p.number AS article_number, p.article_title,
    CASE WHEN p.clause_number IS NULL THEN [] ELSE [p.clause_number] END AS clause_number, p.body
  FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_no, piece_no) - 1 AS chunk_index
    FROM legal_cut
  ) p JOIN docs d ON d.document_id = p.document_id
)"""
