"""Ingestion: pages to documents, chunks and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.embedding import embedding_config
from corpusmill.operators.corpus import assemble_pages, legal_document_chunks
from corpusmill.operators.embed import validate_config

INGEST_CHUNK_SIZE = 1400
INGEST_OVERLAP = 200


def ingest(
    pages: DataFrame, task: str, embed: Callable[[Column], Column], provider: str, model: str,
    dimensions: int, document_type: str = "pdf", existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Document and chunk tables from ``pages(source_path, page_no, text)``.

    ``embed`` turns the chunk text column into its vector. Documents are identified by a hash of their
    source, so that no numbering over all documents is needed. With the documents that ``existing`` already holds,
    a task that was embedded with another configuration is an error before anything is read.
    """
    if existing is not None:
        validate_config(existing, task, {"provider": provider, "model": model, "dimensions": dimensions})
    assembled = assemble_pages(pages).withColumn("document_id", F.xxhash64("source_path"))
    documents = assembled.select(
        "document_id",
        F.lit(task).alias("task"),
        "title",
        "source_path",
        F.lit(document_type).alias("document_type"),
        F.col("page_count").cast("int").alias("page_count"),
        F.regexp_extract("source_path", r"([^/]*)\z", 1).alias("source_file"),
        embedding_config(provider, model, dimensions).alias("embedding_config"),
    )
    texts = assembled.select("document_id", F.lit(task).alias("task"), "title", "source_path", "content")
    chunks = legal_document_chunks(texts, INGEST_CHUNK_SIZE, INGEST_OVERLAP)
    return documents, chunks.withColumn("embedding", embed(F.col("content")))
