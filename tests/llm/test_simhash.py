"""Fingerprints and groups against brute force."""

from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.simhash import fingerprint, keep_one, links, near_duplicates, op5_simhash_near_duplicates


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [word for word in words.split(" ") if word]
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 3]) for at in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(values, distance):
    """Smallest index reachable, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def sample_texts():
    chance = random.Random(3)
    base = [" ".join(chance.choices([f"Word{k}" for k in range(500)], k=chance.randrange(30, 200))) for _ in range(40)]
    out = [None, "", " \n ", "One", "one", "one two", "A b C", "ÄÖ ä b c d", "\x85 x\x1fy"] + base
    for text in base[:20]:
        words = text.split()
        for _ in range(3):
            changed = words[:]
            changed[chance.randrange(len(changed))] = "other"
            out.append(" ".join(changed))
        out.append(text.upper())
    return out


def test_fingerprints_match_the_definition(spark):
    for text in sample_texts():
        assert fingerprint(text) == plain_fingerprint(text)
    by_spark = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert fingerprint("One TWO three") == by_spark % (1 << 64)


def test_groups_match_brute_force(spark, tmp_path):
    given = sample_texts()
    frame = spark.createDataFrame([(10 + at, text) for at, text in enumerate(given)], "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_simhash_near_duplicates(spark, str(tmp_path)).orderBy("doc_id").collect()
    values = [plain_fingerprint(text) for text in given]
    assert [row.fingerprint for row in got] == [f"{value:016x}" for value in values]
    assert [row.component_id - 10 for row in got] == roots(values, 3)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(row.doc_id - 10 for row in kept.collect()) == sorted(set(roots(values, 3)))


def test_links_of_crowded_buckets(spark):
    """Buckets above the limit are cut again and lose nothing."""
    chance = random.Random(5)
    values = {0}
    for _ in range(3):
        centre = chance.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(chance.randrange(7)):
                value ^= 1 << chance.randrange(64)
            values.add(value)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = links(spark.createDataFrame(signed, "fingerprint long"), bucket_rows=8)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    grouped = {row.node % (1 << 64): row.root for row in components(found).collect()}
    want = roots(values, 3)
    for at, value in enumerate(values):
        for other in range(at):
            same = grouped.get(value, value) == grouped.get(values[other], values[other])
            assert same == (want[at] == want[other])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7), (1, 2), (2, 1)]
    got = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 181)} | {k: 500 for k in range(500, 560)} | {1: 1, 2: 1}


def test_null_ids_repeats_and_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "only without an id here"), (None, "only without an id here")]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((row.doc_id or 0, row.component_id or 0) for row in got) == [(0, 0), (0, 0), (0, 4), (4, 4), (4, 4)]
    assert sorted(row.doc_id or 0 for row in keep_one(spark.createDataFrame(rows, schema)).collect()) == [0, 4]
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == [] and keep_one(spark.createDataFrame([], schema)).collect() == []
