"""Language of words and texts: exact marginals, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from corpusmill.llm.language import Field, fit_documents, identify, in_known_language, op2_language, training_pieces, word_features

SYLLABLES = {"en": "th er on an re he ing ion".split(), "fr": "eau oi ou ê è tion ment que".split(), "de": "sch ung keit ä ö ü ein ver".split()}


def text(language, chance, words):
    return " ".join("".join(chance.choice(SYLLABLES[language], 3)) for _ in range(words))


@pytest.fixture(scope="module")
def documents(spark):
    chance = np.random.default_rng(1)
    names = list(SYLLABLES)
    rows = [(at, text(names[at % 3], chance, int(chance.integers(5, 80))), names[at % 3]) for at in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(documents):
    return fit_documents(documents)


def test_marginals_are_exact():
    chance = np.random.default_rng(0)
    field = Field(["a", "b", "c"], {})
    field.transitions = chance.normal(size=(3, 3))
    field.starts = chance.normal(size=3)
    scores = chance.normal(size=(2, 4, 3))
    valid = np.array([[True] * 4, [True, True, False, False]])
    found, pairs, firsts = field.marginals(scores, valid)
    for chain, length in enumerate((4, 2)):
        weights = {}
        for labels in itertools.product(range(3), repeat=length):
            total = field.starts[labels[0]] + sum(scores[chain, t, k] for t, k in enumerate(labels))
            total += sum(field.transitions[a, b] for a, b in zip(labels, labels[1:]))
            weights[labels] = np.exp(total)
        whole = sum(weights.values())
        for t in range(length):
            for k in range(3):
                assert found[chain, t, k] == pytest.approx(sum(w for y, w in weights.items() if y[t] == k) / whole)
    joined = field.word_marginals(np.concatenate([scores[0], scores[1, :2]]), np.array([0, 0, 0, 0, 1, 1]))
    assert joined == pytest.approx(np.concatenate([found[0], found[1, :2]]))


def test_features_of_any_length():
    words = ["a", "ab", "x" * 1000, "größe"]
    numbers, owners = word_features(words, {"ab": 0})
    assert set(owners) == {0, 1, 2, 3} and (owners == 2).sum() == 1000 + 999 + 998 + 997 + 8
    assert len(word_features([], {})[0]) == 0


def test_held_out_accuracy_and_code_switching(spark, documents, model):
    got = identify(documents, model).collect()
    held = [row for row in got if zlib.crc32(str(row.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and sum(row.lang == row.lang_pred for row in held) >= 0.98 * len(held)
    chance = np.random.default_rng(9)
    mixed = text("en", chance, 30).split() + text("fr", chance, 30).split()
    found = model.word_marginals(model.emissions(mixed), np.zeros(60, np.int64)).argmax(axis=1)
    truth = np.array([model.languages.index("en")] * 30 + [model.languages.index("fr")] * 30)
    assert (found == truth).mean() > 0.9


def test_odd_texts_and_clashing_columns(spark, model, documents):
    chance = np.random.default_rng(3)
    texts = [None, "", " 12 ### !", "é", text("de", chance, 70_000), "x" * 20_000, "sch" * 3 + " 1"]
    frame = spark.createDataFrame([(at, t, "kept", 1) for at, t in enumerate(texts)], "doc_id long, text string, score string, other int")
    got = {row.doc_id: row for row in identify(frame, model, added=("lang_pred", "score_2")).collect()}
    assert [got[at].lang_pred for at in range(3)] == ["und"] * 3 and [got[at].score_2 for at in range(3)] == [0.0] * 3
    assert got[4].lang_pred == "de" and all(0 <= row.score_2 <= 1 and row["score"] == "kept" for row in got.values())
    kept = in_known_language(documents.unionByName(frame.selectExpr("doc_id + 1000 AS doc_id", "text", "CAST(NULL AS string) AS lang")))
    assert kept.columns == documents.columns
    ids = {row.doc_id for row in kept.collect()}
    assert ids >= set(range(300)) and not ids & {1000, 1001, 1002}


def test_a_text_is_one_chain_whatever_its_length():
    chance = np.random.default_rng(4)
    field = Field(["a", "b", "c"], {})
    field.transitions, field.starts = chance.normal(size=(3, 3)).astype(np.float32), chance.normal(size=3).astype(np.float32)
    sizes = [1, 700, 64, 65, 3, 1500, 128]
    scores = chance.normal(size=(sum(sizes), 3)).astype(np.float32)
    found = field.word_marginals(scores, np.repeat([4, 5, 9, 10, 11, 20, 30], sizes))
    at = 0
    for size in sizes:
        whole = field.marginals(scores[None, at : at + size], np.ones((1, size), bool))[0][0]
        assert found[at : at + size] == pytest.approx(whole, abs=1e-5)
        at += size
    assert field.word_marginals(scores[:0], np.zeros(0, np.int64)).shape == (0, 3)


def test_stage_rejects_nonsense_and_keeps_switching_texts(spark, documents):
    chance = np.random.default_rng(6)
    mixed = " ".join(text(language, chance, 12) for language in ("en", "fr", "de") * 4)
    letters = list("qxzvkjwpyfgb")
    nonsense = [" ".join("".join(chance.choice(letters, int(chance.integers(3, 7)))) for _ in range(40)) for _ in range(20)] + ["zxq vbn klj wrt " * 10]
    shuffled = [" ".join("".join(chance.permutation(list(word))) for word in text("en", chance, 60).split()) for _ in range(5)]
    rows = [(1000, mixed, None), (1001, "12 ###", None)] + [(2000 + at, value, None) for at, value in enumerate(nonsense)]
    frame = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    kept = {row.doc_id: row for row in in_known_language(frame).collect()}
    assert set(kept) == set(range(300)) | {1000} and kept[1000].lang in SYLLABLES
    background = {row.text: row.background for row in identify(
        spark.createDataFrame([(value,) for value in shuffled], "text string"), fit_documents(documents, background=True), added=("p", "s", "background")).collect()}
    assert min(background.values()) > 0.3
    assert not any(row.lang_pred.startswith("\0") for row in identify(frame, fit_documents(documents, background=True)).collect())


def test_labels_of_held_out_documents_are_not_read(spark, documents, tmp_path):
    changed = documents.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_language(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 300 and "xx" not in {row.lang_pred for row in rows}
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) for row in rows)


def test_bounded_sample(spark, documents):
    pieces = training_pieces(documents, documents=5)
    assert 0 < len(pieces) <= 3 * 5 * 8 and pieces == training_pieces(documents.repartition(3), documents=5)
    repeated = documents.unionByName(documents.crossJoin(spark.range(30)).drop("id"))
    assert sorted(training_pieces(repeated, documents=5)) == sorted(pieces)


def test_nothing_to_learn_from(spark, tmp_path):
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame([(1, "some text", None)], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [tuple(row)[2:] for row in op2_language(spark, f"{tmp_path}/a").collect()] == [("und", 0.0)]
    assert op2_language(spark, f"{tmp_path}/b").collect() == []
