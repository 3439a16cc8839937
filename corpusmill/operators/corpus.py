"""From page text to chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.chunking import check_sizes, chunk_count, chunk_id, fixed_chunks
from corpusmill.functions.legal import CHUNK_METADATA_TYPE, legal_chunks, legal_units, normalize_legal_text
from corpusmill.functions.line_repair import repair_lines
from corpusmill.functions.text import strip, word_count
from corpusmill.session import stored

#: Pages per step of the two-step running sum in ``chunk_pages``.
PAGES_PER_BUCKET = 1024

PAGE_GAP = "\n\n"


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Documents from ``pages(source_path, page_no, text)``: non-blank pages in order, lines repaired.

    The result holds a whole document in one value, as its definition asks. Where a document may
    outgrow that, ``chunk_pages`` gives its chunks without assembling it.
    """
    cleaned = pages.withColumn("text", repair_lines(strip(F.col("text"))))
    page = F.when(F.col("text") != "", F.struct("page_no", "text"))
    ordered = F.array_sort(F.collect_list(page))
    return cleaned.groupBy("source_path").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), PAGE_GAP).alias("content"),
        F.count(F.lit(1)).alias("page_count"),
    ).withColumn("title", file_stem(F.col("source_path")))


def file_stem(path: Column) -> Column:
    """File name without folders and last extension."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def chunk_pages(pages: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks of the assembled documents, computed from the pages without assembling any document.

    Each page learns where it starts inside its document and adds its part to every chunk it
    touches; a chunk gathers at most ``size`` characters, however many pages its document has.
    """
    check_sizes(size, overlap)
    step = size - overlap
    bucket = F.floor(F.col("page_no") / PAGES_PER_BUCKET)
    repaired = (
        pages.filter(F.col("text").rlike(r"(?U)\S"))
        .select("source_path", "page_no", repair_lines(strip(F.col("text"))).alias("text"))
        .select(
            "source_path", "page_no", bucket.alias("bucket"),
            F.concat("text", F.lit(PAGE_GAP)).alias("text"),
        )
        .withColumn("length", F.char_length("text"))
    )
    # Lengths and texts are both read from here, so lines are repaired once.
    parts = stored(repaired, "repaired-pages")
    whole = Window.partitionBy("source_path")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy("source_path", "bucket")
        .agg(F.sum("length").alias("bucket_length"))
        .select(
            "source_path", "bucket",
            F.coalesce(F.sum("bucket_length").over(earlier), F.lit(0)).alias("bucket_start"),
            # The gap behind the last page is no part of the document.
            (F.sum("bucket_length").over(whole) - len(PAGE_GAP)).alias("document_length"),
        )
    )
    within = (
        Window.partitionBy("source_path", "bucket").orderBy("page_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = parts.join(starts, ["source_path", "bucket"]).withColumn(
        "start", F.col("bucket_start") + F.coalesce(F.sum("length").over(within), F.lit(0))
    )
    stop = F.least(F.col("start") + F.col("length"), F.col("document_length"))
    last_chunk = chunk_count(F.col("document_length"), size, overlap) - 1
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1)
    last = F.least(F.floor((stop - 1) / step), last_chunk)
    touched = (
        placed.withColumn("stop", stop)
        .withColumn("first", first.cast("int"))
        .withColumn("last", last.cast("int"))
        .filter("first <= last")
        .withColumn("chunk_index", F.explode(F.sequence("first", "last")))
    )
    left = F.greatest(F.col("start"), F.col("chunk_index") * step)
    right = F.least(F.col("stop"), F.col("chunk_index") * step + size)
    piece = F.substr(
        F.col("text"), (left - F.col("start") + 1).cast("int"), (right - left).cast("int")
    )
    gathered = F.array_sort(F.collect_list(F.struct("page_no", piece.alias("text"))))
    return (
        touched.filter(right > left)
        .groupBy("source_path", "chunk_index")
        .agg(F.array_join(F.transform(gathered, lambda p: p["text"]), "").alias("content"))
        .withColumn("token_count", word_count(F.col("content")))
        .withColumn("chunk_id", chunk_id(F.col("source_path"), F.col("chunk_index")))
    )


def _with_identity(exploded: DataFrame) -> DataFrame:
    return exploded.withColumn("token_count", word_count(F.col("content"))).withColumn(
        "chunk_id", chunk_id(F.col("source_path"), F.col("chunk_index"))
    )


def plain_chunks(documents: DataFrame, size: int = 800, overlap: int = 100, text: str = "content") -> DataFrame:
    """Fixed-size chunks with empty metadata; the other document columns stay."""
    kept = [F.col(name) for name in documents.columns if name != text]
    cut = documents.select(
        *kept, F.posexplode(fixed_chunks(F.col(text), size, overlap)).alias("chunk_index", "content")
    )
    return _with_identity(cut).withColumn("metadata", F.lit(None).cast(CHUNK_METADATA_TYPE))


def legal_document_chunks(
    documents: DataFrame, size: int = 1800, overlap: int = 200, text: str = "content"
) -> DataFrame:
    """Chunks along articles and clauses with their metadata, numbered through each document.

    Everything happens inside the row of a document, so no shuffle is needed for the numbering.
    """
    check_sizes(size, overlap)
    kept = [F.col(name) for name in documents.columns if name != text]
    normalized = documents.select(*kept, normalize_legal_text(F.col(text)).alias("_normalized"))
    units = normalized.withColumn("_units", legal_units(F.col("_normalized")))
    cut = units.select(
        *kept,
        F.posexplode(legal_chunks(F.col("_units"), F.col("_normalized"), size, overlap)).alias(
            "chunk_index", "_chunk"
        ),
    )
    return _with_identity(cut.select(*kept, "chunk_index", "_chunk.content", "_chunk.metadata"))


def corpus_scan(
    documents: DataFrame, chunks: DataFrame, task: str, document_id: int | None = None
) -> DataFrame:
    """Chunks of a task's documents, optionally of one document."""
    chosen = documents.filter(F.col("task") == task)
    if document_id is not None:
        chosen = chosen.filter(F.col("document_id") == document_id)
    return chosen.join(chunks, "document_id")


def replace_documents(existing: DataFrame, incoming: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Rows of ``existing`` whose source is not replaced, and all incoming rows.

    ``replaced`` names the sources that arrive anew; it matters for chunks, where a new document
    without any chunk still removes the old ones.
    """
    sources = (incoming if replaced is None else replaced).select("source_path").distinct()
    return existing.join(sources, "source_path", "left_anti").unionByName(incoming)
