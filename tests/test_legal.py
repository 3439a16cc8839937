"""Article and clause structure, references and chunk metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.legal import (
    articles, clauses, cross_references, location_display, normalize_legal_text, reference_display,
)
from corpusmill.operators.corpus import assemble_pages, chunk_pages, legal_document_chunks, plain_chunks
from tests.test_text import chunk_by_walking, column, repair_by_scanning

TEXT = "pre\nArticle 1\nScope\n1. alpha\nmore\n2. beta\nArticle 2\nNo clauses here\nbody\nArticle 3\n"


def legal(spark, *texts, size=1800, overlap=200):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_path string, content string")
    return legal_document_chunks(docs, size, overlap).orderBy("source_path", "chunk_index").collect()


def test_normalize(spark):
    text = "Ar ticle 5\r\nCHAP TER one \t\nsec tion tit\nle article of title"
    assert column(spark, [text], "string", normalize_legal_text) == ["Article 5\nCHAPTER one\nSECTION TITLE Article of TITLE"]


def test_units_of_the_example(spark):
    rows = legal(spark, TEXT)
    assert [r.content for r in rows] == [
        "Article 1\nScope\n1. alpha\nmore", "Article 1\nScope\n2. beta", "Article 2\nNo clauses here\nbody",
    ]
    assert [(r.metadata.article_number, r.metadata.clause_number, r.metadata.article_title) for r in rows] == [
        ("1", [1], "Scope"), ("1", [2], "Scope"), ("2", [], "No clauses here"),
    ]
    assert rows[0].metadata.hierarchy_labels == ["article:1", "article_title:Scope", "clause:1"]
    assert [r.chunk_id for r in rows] == ["d0::chunk::0", "d0::chunk::1", "d0::chunk::2"]


def test_text_without_articles_is_cut_plainly(spark):
    text = "tit le and no heading " * 20
    rows = legal(spark, text, size=50, overlap=10)
    assert [r.content for r in rows] == chunk_by_walking(text.replace("tit le", "TITLE"), 50, 10)
    assert all(r.metadata is None for r in rows)


def test_long_units_are_cut_and_numbered_through(spark):
    body = "x" * 130
    rows = legal(spark, f"Article 1a\nT\n1. {body}\n2. short\n", size=60, overlap=20)
    pieces = chunk_by_walking(f"Article 1a\nT\n1. {body}", 60, 20) + ["Article 1a\nT\n2. short"]
    assert [r.content for r in rows] == pieces
    assert [r.chunk_index for r in rows] == list(range(len(pieces)))
    assert rows[1].metadata.clause_number == [1]


def test_heading_quirks(spark):
    # A heading over two lines keeps its number; a lone "1." becomes the title; years count as clauses.
    found = column(spark, ["Article\n12\nTitle\ntext"], "string", articles)[0]
    assert [(a.number, a.heading, a.title, a.body) for a in found] == [("12", "Article", "12", "Title\ntext")]
    found = column(spark, ["Article 1\n1.\n2. b"], "string", articles)[0]
    assert (found[0].title, found[0].body) == ("1.", "2. b")
    parts = column(spark, ["lead\n2023. year\n1.\nalone"], "string", clauses)[0]
    assert [(c.number, c.text) for c in parts] == [(2023, "2023. year"), (1, "1.\nalone")]


def references(spark, text, article="5", numbers=(1,)):
    frame = spark.createDataFrame([(text, article, list(numbers))], "t string, a string, c array<bigint>")
    return frame.select(cross_references(F.col("t"), F.col("a"), F.col("c")).alias("r")).first().r


def test_cross_references(spark):
    found = references(spark, "paragraph 2 of Article 7, Article 5 and clause 3 of this Article")
    assert [tuple(r) for r in found] == [("7", 2, "same_document"), ("7", None, "same_document"), ("5", 3, "same_article")]
    # The same key found first keeps its scope; the own clause and article are left out.
    found = references(spark, "clause 3 of Article 5, clause 3 of the article, paragraph 1 of this Article, Articles 9b, article 9b")
    assert [tuple(r) for r in found] == [("5", 3, "same_document"), ("9b", None, "same_document")]


def test_displays(spark):
    frame = spark.createDataFrame([("5", [1, 2]), (None, [3]), ("", [])], "a string, c array<bigint>")
    shown = [r[0] for r in frame.select(location_display(F.col("a"), F.col("c"))).collect()]
    assert shown == ["Article 5 | Clause 1, 2", "Clause 3", ""]
    labels = spark.sql(
        "select array(named_struct('article_number','7','clause_number',2L,'scope','same_document'),"
        "named_struct('article_number','5','clause_number',cast(null as bigint),'scope','same_article')) as r"
    ).select(reference_display(F.col("r"))).first()[0]
    assert labels == ["Article 7, Clause 2", "Article 5 (same article)"]


def test_pages_to_documents_and_chunks(spark):
    pages = {
        "a/b.c.pdf": ["  pro vi ders  ", "", "second page\n", " \n ", "x" * 97],
        "one.txt": ["only"],
        "blank": [" ", ""],
        "long": [f"page {i} " + "y" * (i % 7) for i in range(2500)],
    }
    rows = [(s, i, t) for s, texts in pages.items() for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "source_path string, page_no int, text string")
    content = {s: "\n\n".join(repair_by_scanning(t.strip()) for t in texts if t.strip()) for s, texts in pages.items()}
    got = {r.source_path: r for r in assemble_pages(frame).collect()}
    assert {s: r.content for s, r in got.items()} == content
    assert {s: r.page_count for s, r in got.items()} == {s: len(t) for s, t in pages.items()}
    assert (got["a/b.c.pdf"].title, got["one.txt"].title, got["blank"].title) == ("b.c", "one", "blank")
    for size, overlap in ((30, 5), (800, 100), (10, 8)):
        found = chunk_pages(frame, size, overlap).collect()
        by_id = {r.chunk_id: r.content for r in found}
        expected = {
            f"{s}::chunk::{i}": piece for s, text in content.items() for i, piece in enumerate(chunk_by_walking(text, size, overlap))
        }
        assert by_id == expected


def test_plain_chunks_record(spark):
    docs = spark.createDataFrame([("s", "one two  three")], "source_path string, content string")
    row = plain_chunks(docs).first()
    assert (row.chunk_id, row.chunk_index, row.token_count, row.metadata) == ("s::chunk::0", 0, 3, None)
