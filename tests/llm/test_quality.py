"""The rule ledger against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm.quality import POLICIES, RULES, ablations, ledger, measure, op6_quality_ledger, passing, policy_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[at : at + 8]) for at in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {at + k for at, window in enumerate(windows) if counts[window] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines),
        (text or "").count("!"),
    )


def texts():
    chance = random.Random(4)
    out = [None, "", "  \n\t ", "one", "a b c d e f g h", "a " * 9, "x " * 500, "é ü \x1f w\x0bz\x85y", "!!! " * 30, "long" * 3000]
    for _ in range(60):
        words = chance.choices([f"w{k}" for k in range(chance.choice((5, 40, 4000)))], k=chance.randrange(1, 300))
        if chance.random() < 0.5:
            at = chance.randrange(len(words))
            words += words[at : at + chance.randrange(1, 30)]
        out.append("".join(word + chance.choice((" ", " ", "\n", "# ", ".\t")) for word in words))
    block = "p q r s t u v w x y"
    out += [f"{block} 1 {block} 2 {block}", f"{block}\n{block}\n{block}", " ".join(["a b"] * 30)]
    return out


def test_measurements(spark):
    given = texts()
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = measure(frame).orderBy("doc_id").collect()
    for row, text in zip(got, given):
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.n_lines, row.n_exclaims)
        assert found == plain(text), text


def test_policies_and_ablations(spark, tmp_path):
    given = texts() + ["clean words of a text " + " ".join(f"w{k}" for k in range(40))]
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_quality_ledger(spark, str(tmp_path)).collect()
    for row, text in zip(sorted(rows), given):
        words, chars, symbols, dups, repeats, lines, exclaims = plain(text)
        failed = [words < 20, 100 * repeats > 30 * words, 10 * symbols > words, 2 * chars < 5 * words, chars > 12 * words, 2 * dups > lines, 2 * exclaims > words]
        assert row.failed_bits == sum(bit << at for at, bit in enumerate(failed))
        assert row.base_failed == any(failed[:2]) and row.kept == (not any(failed))
    kept = {row.doc_id for row in passing(frame.withColumn("failed_bits", F.lit("x"))).collect()}
    assert kept == {row.doc_id for row in rows if row.kept} and len(given) - 1 in kept
    for policy in POLICIES:
        mask = policy_mask(policy)
        bits = [row.failed_bits & mask for row in rows]
        for found in ablations(ledger(frame), policy).collect():
            bit = 1 << list(RULES).index(found.rule)
            assert (found.failed, found.only_rule, found.kept) == (sum(b & bit > 0 for b in bits), bits.count(bit), bits.count(0))
            assert found.kept_without == found.kept + found.only_rule


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ledger(frame).collect() == [] and passing(frame).collect() == []
