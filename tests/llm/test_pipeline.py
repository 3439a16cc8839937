"""The pipeline against its stages in plain Python, and the registered queries of the subpackage."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import catalog
from corpusmill.llm.packing import TOKENIZER
from tests.llm.test_quality import plain
from tests.llm.test_sharding_mixing import expected_mix
from tests.llm.test_similar import plain_groups
from tests.llm.test_simhash import plain_fingerprint, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    chance = random.Random(8)
    words = {"en": ["the", "of", "thing", "other", "then", "with", "shall"], "fr": ["le", "eau", "être", "où", "nation", "même", "voix"]}
    rows = []
    for at in range(120):
        language = "en" if at % 3 else "fr"
        text = " ".join("".join(chance.choices(words[language], k=2)) + str(chance.randrange(9)) * (chance.random() < 0.3) for _ in range(chance.randrange(25, 120)))
        rows.append((at, text, language, f"s{at % 5}"))
    rows += [(200 + at, rows[at][1], rows[at][2], "s9") for at in range(10)]
    for at in range(20, 40):  # near copies: one word of the whole is another one, or two of the longer texts
        parts = rows[at][1].split()
        for place in range(len(parts) // 2, len(parts), 55):
            parts[place] = words[rows[at][2]][0] * 2
        rows.append((400 + at, " ".join(parts), rows[at][2], "s8"))
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, "too short", "en", "s1"), (303, "12 " * 3 + " ".join(f"{k}" for k in range(40)), None, None)]
    rows += [(304, "### " * 40, "en", "s2"), (305, " ".join(f"other thing{k} shall" for k in range(3000)), None, None), (None, " ".join(f"le{k} eau" for k in range(40)), None, "s3")]
    rows.append(rows[5])
    return [(*row, len(row[1] or "")) for row in rows]


def kept_by_rules(text):
    n, chars, symbols, dups, repeats, lines, exclaims = plain(text)
    return not (n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or 2 * chars < 5 * n or chars > 12 * n or 2 * dups > lines or 2 * exclaims > n)


def test_stages_against_plain_python(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language", "near_dedup", "source_mix", "packed"]
    ruled = stages["quality_rules"](spark, frame, "")
    assert Counter(map(tuple, ruled.collect())) == Counter(row for row in documents() if kept_by_rules(row[1]))
    spoken = stages["language"](spark, ruled, "")
    # Only the text of numbers has no letter; a language that isn't given is the predicted one.
    given = [tuple(row) for row in spoken.collect()]
    filled = {305: "en", None: "fr"}
    assert Counter(given) == Counter(
        (*row[:2], row[2] or filled[row[0]], *row[3:]) for row in documents() if kept_by_rules(row[1]) and row[0] != 303)
    texts = [row[1] for row in given]
    # The data tells groups of similar texts from groups of near fingerprints.
    assert len(set(plain_groups(texts))) < len(set(roots([plain_fingerprint(text) for text in texts], 3)))
    groups = defaultdict(list)
    for row, root in zip(given, plain_groups([row[1] for row in given])):
        groups[root].append(row)
    single = stages["near_dedup"](spark, spoken, "")
    want = Counter(min(rows, key=lambda r: (r[0] is None, r[0] or 0)) for rows in groups.values())
    assert Counter(map(tuple, single.collect())) == want
    mixed = stages["source_mix"](spark, single, "").collect()
    taken = expected_mix([(row[0], row[3], len((row[1] or "").split())) for row in want])
    by_id = Counter()
    for row in mixed:
        by_id[-1 if row.doc_id is None else row.doc_id] += len(row.text.split())
    assert by_id == Counter({i: n for i, _, _, _, n in taken if n})
    texts = {row[0]: row[1] for row in want}
    assert all(row.text == texts[row.doc_id] or " ".join(texts[row.doc_id].split()).startswith(row.text) for row in mixed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    packed = stages["packed"](spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    assert sum(row["length"] for row in packed) == sum(len(tokenizer.encode(row.text, add_special_tokens=False).ids) + 1 for row in mixed)
    for found in _by_sequence(packed).values():
        assert found[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:])) and sum(found[-1]) <= 2048


def _by_sequence(rows):
    out = defaultdict(list)
    for row in rows:
        out[row.sequence_id].append((row.offset, row["length"]))
    return {key: sorted(found) for key, found in out.items()}


def test_run_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    names = ("score", "failed_bits", "n_words", "_fingerprint", "_root", "taken", "row", "lang_pred", "_language", "text_")
    docs = spark.createDataFrame(documents(), SCHEMA).withColumns({name: F.lit("kept") for name in names})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    assert set(docs.select("score", "row", "taken").distinct().collect()) == {("kept", "kept", "kept")}
    assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, "").columns


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_registered_names():
    assert [name.split("_")[0] for name in catalog.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [name for name, (_, sql) in catalog.QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    run, sql = catalog.QUERIES[name]
    frame = run(spark, folder)
    database = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    listed = ", ".join(f'"{column}"' for column in sorted(frame.columns))
    want = database.sql(f"SELECT {listed} FROM ({sql}) AS t").fetchall()
    assert sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr) == sorted(want, key=repr)
