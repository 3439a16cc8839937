"""Shards and mixes against plain Python; edge cases."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from corpusmill.llm.mixing import mix_sources, mixed_documents, op8_source_mix
from corpusmill.llm.sharding import balanced_shards, op4_balanced_shards

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows, schema=DOCUMENTS):
    return spark.createDataFrame(rows, schema)


ODD = [
    (5, "Große Häuser\x0bstehen\there", "de", "b", 3), (None, "no id", None, None, None), (1, None, "en", "a", None), (2, "", "en", "", 0),
    (3, "x" * 5000, "en", "a", 1), (4, "same", "en", "a", 1), (4, "same", "en", "a", 1), (9, "one two three four", None, "c", 2), (7, " \n ", "en", "b", 1),
]


@pytest.fixture
def folder(spark, tmp_path):
    rows_of(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_shards_of_odd_documents(spark, folder):
    got = op4_balanced_shards(spark, folder).collect()
    assert len(got) == len(ODD) and {row.law for row in got} == {"bytes"}
    sizes = sorted((len((text or "").encode()) + 16, zlib.crc32((text or "").encode())) for _, text, *_ in ODD)
    assert sorted((row["size"], row.text_crc32) for row in got) == sizes
    slots = defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert all(0 <= shard < 40 for shard in slots)


def test_shards_are_contiguous_and_nearly_equal(spark):
    frame = spark.range(3000).selectExpr("id", "id * 7919 % 100 + 1 AS size", "id % 2 = 0 AS Shard", "'x' AS other")
    got = balanced_shards(frame, "size", ["id"], 8)
    assert got.columns == ["id", "size", "other", "shard", "slot"]
    rows = sorted(got.collect())
    total = sum(row["size"] for row in rows)
    before, totals = 0, defaultdict(int)
    for row in rows:
        assert row.shard == min((2 * before + row["size"]) * 8 // (2 * total), 7)
        before += row["size"]
        totals[row.shard] += row["size"]
    assert [row.shard for row in rows] == sorted(row.shard for row in rows)
    assert max(totals.values()) - min(totals.values()) <= 200


def expected_mix(rows, epochs=3):
    """identity, source, size to taken words, by the definition."""
    totals = defaultdict(int)
    for _, source, size in rows:
        totals[source] += size or 0
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {source: at % 3 + 1 for at, source in enumerate(order)}
    everything = sum(totals.values())
    target, capped = {}, set()
    while True:
        rest = everything - sum(epochs * totals[s] for s in capped)
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        target = {s: epochs * totals[s] if s in capped else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in capped and target[s] > epochs * totals[s]}
        if not over:
            break
        capped |= over
    taken = []
    for source in order:
        budget, size_of_source = int(target[source] + 0.5), totals[source]
        mine = sorted(
            (md5(f"{'' if i is None else i}:8".encode()).hexdigest(), i if i is not None else -1, size or 0) for i, s, size in rows if s == source
        )
        before = 0
        for _, i, size in mine:
            whole = budget // size_of_source if size_of_source else 0
            part = min(max(budget - whole * size_of_source - before, 0), size) if size_of_source else 0
            taken.append((i, size, size_of_source, round(target[source], 6), whole * size + part))
            before += size
    return sorted(taken)


def test_mix_against_plain_python(spark):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", (i * 37) % 50) for i in range(400)] + [(500, None, 40), (501, "", 3), (None, "s1", None), (7, "s0", 9), (7, "s0", 9)]
    got = mix_sources(rows_of(spark, rows, "doc_id long, source string, size long"), "doc_id", "source", "size").collect()
    found = sorted((row.doc_id if row.doc_id is not None else -1, row["size"], row.source_size, round(row.target, 6), row.taken) for row in got)
    assert found == expected_mix(rows)


def test_mix_of_odd_documents(spark, folder):
    got = op8_source_mix(spark, folder).collect()
    assert len(got) == len(ODD) and all(0 <= row.taken <= 3 * row["size"] for row in got)
    by_source = defaultdict(int)
    for row in got:
        by_source[row.source] += row.taken
    assert all(by_source[row.source] == int(row.target + 0.5) for row in got)


def test_mixed_documents_repeat_and_cut(spark):
    rows = [(i, f"w{i} a b\nc", "en", "s0", 7) for i in range(20)] + [(100, "u v w", "en", "s1", 5)]
    frame = rows_of(spark, rows).withColumnRenamed("lang", "taken")
    got = mixed_documents(frame)
    assert got.columns == frame.columns
    found = got.collect()
    words = sum(len(row.text.split()) for row in found if row.source == "s0")
    # 83 words by weights 1 and 2: s1 may have 9 at most, so s0 gets 74.
    assert words == 74 and [row.text for row in found if row.source == "s1"] == ["u v w"] * 3
    assert all(row.n_chars == (7 if len(row.text.split()) == 4 and "\n" in row.text else len(row.text)) for row in found if row.source == "s0")


def test_cut_document_keeps_its_lines(spark):
    # 47 words by weights 1 and 2: s1 may have 6 at most, so s0 gets 41 of 45 and its last document is cut after 41.
    text = " \n\x85" + " ".join(f"w{k}\tx\n\n y" for k in range(15)) + " \n"
    found = mixed_documents(rows_of(spark, [(1, text, "en", "s0", len(text)), (2, "u v", "en", "s1", 3)])).filter("source = 's0'").collect()
    assert len(found) == 1 and found[0].n_chars == len(found[0].text)
    assert text.startswith(found[0].text) and "\n\n y" in found[0].text and found[0].text.endswith("w13\tx")


def test_empty_tables(spark, tmp_path):
    rows_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_balanced_shards(spark, str(tmp_path)).collect() == []
    assert op8_source_mix(spark, str(tmp_path)).collect() == []
    assert mixed_documents(rows_of(spark, [])).collect() == []
