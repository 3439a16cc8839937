"""Spelling variants against edit distances of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from corpusmill.llm import spelling


def one_edit(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for at, y in enumerate(b):
            new.append(min(row[at] + (x != y), row[at + 1] + 1, new[at] + 1))
        row = new
    return row[-1] == 1


def plain_vocabulary(rows):
    counts = Counter()
    for identity, text in rows:
        lowered = re.sub("[A-Z]", lambda found: found.group().lower(), text or "")
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if identity is None else identity}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def deletions(word):
    return {word[:at] + word[at + 1 :] for at in range(len(word))}


def near_pairs(words):
    """All pairs one edit apart: candidates share the word or a deletion of one letter, then the distance is computed."""
    held = {}
    for word in words:
        for part in deletions(word) | {word}:
            held.setdefault(part, set()).add(word)
    return {(a, b) for group in held.values() for a in group for b in group if a != b and one_edit(a, b)}


def plain_variants(counts):
    near = {word: [] for word in counts}
    for a, b in near_pairs(counts):
        near[a].append(b)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * counts[word] else None
    out = set()
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None))
    return out


def made_counts(count, letters="abcé", seed=1):
    chance = random.Random(seed)
    words = {"".join(chance.choice(letters) for _ in range(chance.randrange(6, 10))) for _ in range(count)}
    return {word: chance.choice([5, 5, 6, 30, 150, 150, 4000, 10**12]) for word in words}


def test_scan_finds_all_near_words_with_the_beginning():
    chance = random.Random(0)
    for _ in range(60):
        letters = "abé"[: chance.randrange(1, 4)]
        words = sorted({"".join(chance.choice(letters) for _ in range(chance.randrange(1, 8))) for _ in range(60)})
        for word in [*chance.sample(words, min(6, len(words))), "abbab", "zz"]:
            for shared in range(len(word)):
                expected = [at for at, other in enumerate(words) if other[:shared] == word[:shared] and one_edit(other, word)]
                assert spelling.scan(words, word, shared) == expected


@pytest.mark.parametrize("list_words, asking_words", [(50, 30), (100_000, 100_000)])
def test_near_words_across_lists(spark, list_words, asking_words):
    counts = made_counts(700) | {"a" * size: 5 for size in (6, 7, 8, 90, 91, 92)} | {"ab" * 40 + "c" * at: 7 for at in range(4)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(row.word, row.n, row.n_near, row.best, row.best_n) for row in spelling.near_words(frame, list_words, asking_words).collect()}
    near = {}
    for a, b in near_pairs(counts):
        near.setdefault(a, []).append(b)
    expected = set()
    for word, n in counts.items():
        best = min(near.get(word, []), key=lambda other: (-counts[other], other), default=None)
        expected.add((word, n, len(near.get(word, [])), best, counts.get(best)))
    assert got == expected


def test_forms_and_roots(spark):
    counts = made_counts(900, seed=4)
    frame = spark.createDataFrame([(word, n, "x", 1) for word, n in counts.items()], "word string, n long, form string, list int")
    got = {tuple(row) for row in spelling.variants(frame).collect()}
    assert got == plain_variants(counts)
    assert any(form and root != form for _, form, root, *_ in got)


def test_long_chain_of_forms(spark):
    links = [(f"w{at}", f"w{at + 1}") for at in range(20)] + [("x", "w3")]
    got = {row.word: row.root for row in spelling.last_forms(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {word: "w20" for word, _ in links}


def test_vocabulary_counts_lower_cases_and_misspells(spark):
    chance = random.Random(6)
    words = ["".join(chance.choice("abcdéÉÀÿ×ABZ") for _ in range(chance.randrange(4, 12))) for _ in range(40)]
    texts = [" ".join(chance.choices(words, k=60)) + chance.choice([" ", "-", "1", "Ā", "😀"]) for _ in range(80)]
    rows = [*enumerate(texts), (None, None), (None, texts[0]), (7, ""), (7, texts[1]), (7, texts[1]), (99, "Abcdefgh " * 50_000)]
    frame = spark.createDataFrame([(*row, "x", 3) for row in rows], "doc_id long, text string, run string, n int")
    assert {row.word: row.n for row in spelling.vocabulary(frame).collect()} == plain_vocabulary(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    one = spark.createDataFrame([("single", 9)], "word string, n long")
    assert [tuple(row) for row in spelling.variants(one).collect()] == [("single", None, "single", 9, 0, None)]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    documents = [tuple(row) for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(row) for row in spelling.op11_spelling_variants(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_vocabulary(documents))
