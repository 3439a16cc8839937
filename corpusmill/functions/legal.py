"""Article and clause structure of legal text as nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.chunking import fixed_chunks
from corpusmill.functions.text import bind, lines, strip

# Line ends are "\n" only (d), ^ and $ work per line (m), classes follow Unicode (U).
HEADING = r"Article\s+(\d+[A-Za-z]?)\s*$"
CLAUSE_START = r"\s*(\d+)\.\s"
BEFORE_HEADING = rf"(?Udm)(?=^{HEADING})"
BEFORE_CLAUSE = rf"(?Udm)(?=^{CLAUSE_START})"
AT_HEADING = rf"(?Udm)\A{HEADING}"
AT_CLAUSE = rf"(?Udm)\A{CLAUSE_START}"

# Headings that extraction tears apart, and what they become. The first letter is looked at before the word
# boundary, which costs more.
TORN_HEADINGS = (
    (r"(?=A)\bAr\s*ticle\b", "Article"),
    (r"(?=C)\bCHAP\s*TER\b", "CHAPTER"),
    (r"(?=S)\bSEC\s*TION\b", "SECTION"),
    (r"(?=T)\bTIT\s*LE\b", "TITLE"),
)


def normalize_legal_text(text: Column) -> Column:
    """Unix line ends, headings in one piece and no blanks before a line end."""
    fixed = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for pattern, replacement in TORN_HEADINGS:
        fixed = F.regexp_replace(fixed, f"(?iU){pattern}", replacement)
    return F.regexp_replace(fixed, r"[ \t]+\n", "\n")


def articles(normalized: Column) -> Column:
    """array<struct<number, heading, title, body>> of the articles that have a body.

    Text before the first heading belongs to no article.
    """
    blocks = F.filter(F.split(normalized, BEFORE_HEADING), lambda block: block.rlike(AT_HEADING))

    def split_head(block: Column) -> Column:
        content = F.filter(F.transform(lines(strip(block)), strip), lambda line: line != "")

        def describe(content_lines: Column) -> Column:
            second = F.get(content_lines, F.lit(1))
            has_title = F.coalesce(~second.rlike(AT_CLAUSE), F.lit(False))
            first_body = F.when(has_title, 3).otherwise(2)
            body = F.slice(content_lines, first_body, F.size(content_lines))
            return F.struct(
                F.regexp_extract(block, AT_HEADING, 1).alias("number"),
                F.get(content_lines, F.lit(0)).alias("heading"),
                F.when(has_title, second).otherwise("").alias("title"),
                F.array_join(body, "\n").alias("body"),
            )

        return bind(content, describe)

    return F.filter(F.transform(blocks, split_head), lambda article: article["body"] != "")


def clauses(body: Column) -> Column:
    """array<struct<number, text>>: clauses start at lines "n. "; text before the first is left out."""
    blocks = F.filter(F.split(body, BEFORE_CLAUSE), lambda block: block.rlike(AT_CLAUSE))
    return F.transform(
        blocks,
        lambda block: F.struct(
            F.regexp_extract(block, AT_CLAUSE, 1).try_cast("bigint").alias("number"),
            strip(block).alias("text"),
        ),
    )


def unit_text(heading: Column, title: Column, body: Column) -> Column:
    """Heading, title when there is one, and body, one below the other."""
    return strip(F.concat_ws("\n", heading, F.nullif(title, F.lit("")), body))


def hierarchy_labels(number: Column, title: Column, clause_numbers: Column) -> Column:
    """Labels such as article:5, article_title:Scope, clause:2."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.concat(F.lit("article:"), number)),
        F.when(title != "", F.array(F.concat(F.lit("article_title:"), title))).otherwise(none),
        F.transform(clause_numbers, lambda clause: F.concat(F.lit("clause:"), clause.cast("string"))),
    )


# How a text refers to articles and clauses.
ARTICLE_REFERENCE = r"(?iU)(?=A)\bArticles?\s+(\d+[A-Za-z]?)\b"
CLAUSE_OF_ARTICLE = r"(?iU)(?=[cp])\b(?:clause|paragraph)\s+(\d+)\s+of\s+Articles?\s+(\d+[A-Za-z]?)\b"
CLAUSE_OF_THIS_ARTICLE = r"(?iU)(?=[cp])\b(?:clause|paragraph)\s+(\d+)\s+of\s+(?:this|the)\s+Article\b"


def _reference(article: Column, clause: Column, scope: str) -> Column:
    return F.struct(
        article.cast("string").alias("article_number"),
        clause.try_cast("bigint").alias("clause_number"),
        F.lit(scope).alias("scope"),
    )


def cross_references(text: Column, current_article: Column, current_clauses: Column) -> Column:
    """References to other articles and clauses, each (article, clause) once.

    Order: clauses of a named article, named articles, clauses of this article. An article does not
    refer to itself and a clause not to itself.
    """

    def every(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def own_clause(reference: Column) -> Column:
        return F.array_contains(current_clauses, reference["clause_number"])

    named_clauses = F.array_distinct(
        F.filter(
            F.zip_with(
                every(CLAUSE_OF_ARTICLE, 1),
                every(CLAUSE_OF_ARTICLE, 2),
                lambda clause, article: _reference(article, clause, "same_document"),
            ),
            lambda r: ~((r["article_number"] == current_article) & own_clause(r)),
        )
    )
    named_articles = F.array_distinct(
        F.filter(
            F.transform(
                every(ARTICLE_REFERENCE, 1),
                lambda article: _reference(article, F.lit(None), "same_document"),
            ),
            lambda r: r["article_number"] != current_article,
        )
    )
    own_clauses = F.array_distinct(
        F.filter(
            F.transform(
                every(CLAUSE_OF_THIS_ARTICLE, 1),
                lambda clause: _reference(current_article, clause, "same_article"),
            ),
            lambda r: ~own_clause(r),
        )
    )

    def same_key(left: Column, right: Column) -> Column:
        return (left["article_number"] == right["article_number"]) & (
            left["clause_number"] == right["clause_number"]
        )

    return bind(
        named_clauses,
        lambda first: F.concat(
            first,
            named_articles,
            F.filter(own_clauses, lambda r: ~F.exists(first, lambda seen: same_key(seen, r))),
        ),
    )


def legal_units(normalized: Column) -> Column:
    """One struct per clause, or per article without clauses: metadata and composed text."""

    def unit(article: Column, clause_numbers: Column, body: Column) -> Column:
        return F.struct(
            article["number"].alias("article_number"),
            clause_numbers.alias("clause_number"),
            article["title"].alias("article_title"),
            hierarchy_labels(article["number"], article["title"], clause_numbers).alias("hierarchy_labels"),
            cross_references(body, article["number"], clause_numbers).alias("cross_references"),
            unit_text(article["heading"], article["title"], body).alias("text"),
        )

    def of_article(article: Column) -> Column:
        no_clause = F.array().cast("array<bigint>")
        return bind(
            clauses(article["body"]),
            lambda parts: F.when(
                F.size(parts) > 0,
                F.transform(parts, lambda c: unit(article, F.array(c["number"]), c["text"])),
            ).otherwise(F.array(unit(article, no_clause, article["body"]))),
        )

    return F.flatten(F.transform(articles(normalized), of_article))


CHUNK_METADATA_TYPE = (
    "struct<article_number: string, clause_number: array<bigint>, article_title: string, "
    "hierarchy_labels: array<string>, cross_references: "
    "array<struct<article_number: string, clause_number: bigint, scope: string>>>"
)


def legal_chunks(units: Column, normalized: Column, size: int = 1800, overlap: int = 200) -> Column:
    """array<struct<content, metadata>>: units, cut when too long; plain chunks when there is no unit."""

    def pieces(unit: Column) -> Column:
        metadata = F.struct(
            unit["article_number"].alias("article_number"),
            unit["clause_number"].alias("clause_number"),
            unit["article_title"].alias("article_title"),
            unit["hierarchy_labels"].alias("hierarchy_labels"),
            unit["cross_references"].alias("cross_references"),
        )
        return F.transform(
            fixed_chunks(unit["text"], size, overlap),
            lambda content: F.struct(content.alias("content"), metadata.alias("metadata")),
        )

    plain = F.transform(
        fixed_chunks(normalized, size, overlap),
        lambda content: F.struct(
            content.alias("content"), F.lit(None).cast(CHUNK_METADATA_TYPE).alias("metadata")
        ),
    )
    return F.when(F.size(units) > 0, F.flatten(F.transform(units, pieces))).otherwise(plain)


def location_display(article_number: Column, clause_numbers: Column, separator: str = " | ") -> Column:
    """"Article 5 | Clause 1, 2"; empty without either."""
    joined = F.array_join(F.transform(clause_numbers, lambda n: n.cast("string")), ", ")
    return F.concat_ws(
        separator,
        F.when(article_number != "", F.concat(F.lit("Article "), article_number)),
        F.when(F.size(clause_numbers) > 0, F.concat(F.lit("Clause "), joined)),
    )


def reference_display(references: Column) -> Column:
    """Readable form of each cross-reference."""
    return F.transform(
        references,
        lambda r: F.concat(
            F.lit("Article "),
            r["article_number"],
            F.coalesce(F.concat(F.lit(", Clause "), r["clause_number"].cast("string")), F.lit("")),
            F.when(r["scope"] == "same_article", " (same article)").otherwise(""),
        ),
    )


