"""Main text and nearest vectors."""

from __future__ import annotations

import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import neighbours
from corpusmill.llm.html_text import (
    TreeModel, extract, fit, label_nodes, labelled, main_text, make_layout, node_features, op9_main_text, parse_page,
)

SENTENCES = [f"Sentence number {k} tells about things, and it is of some length." for k in range(40)]


def page(at):
    chance = random.Random(at)
    body = "".join(f"<p>{html.escape(' '.join(chance.choices(SENTENCES, k=chance.randrange(1, 4))))}</p>" for _ in range(chance.randrange(1, 6)))
    return (
        f"<!DOCTYPE html><html><head><title>T {at}</title><style>p{{x:1}}</style><script>var t='</p><p>no</p>';</script></head><body>"
        f"<nav><ul><li><a href=#>Home</a></li><li><a href=#>More</a></li></ul></nav><!-- ad --><div class='ad'>Buy now. It is cheap.</div>"
        f"<article><h1>Title &amp; {at}</h1><p><b>Bold <i>in</i>line<br>x\n\n y &copy; &am<p>{body}</article><footer>&copy; site &middot; words here.</footer>"
    )


@pytest.fixture(scope="module")
def model():
    return fit([page(at) for at in range(30)])


def test_exact_text_of_pages(model):
    for at in range(30, 60):
        source = page(at)
        body = source[source.index("<article>") : source.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", body))).split())
        assert main_text(source, model) == want


def test_marginals_are_exact():
    tree = parse_page("<article><p>a <b class=x>b</b></p><div>c</div></article>")
    chance = random.Random(1)
    field = TreeModel()
    field.nodes = [chance.gauss(0, 1) for _ in field.nodes]
    field.edges = [[chance.gauss(0, 1) for _ in range(4)] for _ in field.edges]
    features = node_features(tree)
    from corpusmill.llm.html_text import _number

    count, total, ones = len(tree.tags), 0.0, [0.0] * len(tree.tags)
    for labels in itertools.product((0, 1), repeat=count):
        score = sum(field.nodes[f] for node in range(count) if labels[node] for f in features[node])
        score += sum(field.edges[_number(f"edge {tree.tags[n]}")][2 * labels[tree.parents[n]] + labels[n]] for n in range(1, count))
        total += math.exp(score)
        for node in range(count):
            ones[node] += labels[node] * math.exp(score)
    assert field.marginals(tree, features)[0] == pytest.approx([one / total for one in ones])


def test_held_out_layouts(model):
    chance = np.random.default_rng(5)
    wrong = texts = 0
    for _ in range(200):
        tree, labels = labelled(make_layout(SENTENCES, chance))
        found, _ = model.marginals(tree, node_features(tree))
        shown = {node for node, text in tree.texts if text and text.strip()}
        texts += len(shown)
        wrong += sum((found[node] >= 0.5) != labels[node] for node in shown)
    assert wrong <= 0.02 * texts


def test_malformed_pages(model):
    for source in ("", "</p></div>", "<", "<a <b", "<p" * 3000, "<div>" * 5000, "<script>x", "<!--", "&#x;&;&#99999999;", "\x00<p>\x00"):
        assert isinstance(main_text(source, model), str)
    long = "<article>" + "<p>Word after word. </p>" * 20_000 + "</article>"
    assert main_text(long, model) == " ".join(["Word after word."] * 20_000)
    tree = parse_page("<head><title>t</title><p>x<li>a<li>b")
    assert tree.tags == ["#page", "head", "title", "p", "li", "li"] and label_nodes(tree, 0) == [0] * 6


def test_deep_pages_take_time_in_proportion_to_their_length(model):
    import time

    started = time.perf_counter()
    for source in ("<div><b>" * 25_000, "<b>" * 50_000, "<p><b>" * 25_000, "<head>" + "<i>" * 30_000 + "<p>" * 20_000, "<svg>" * 50_000,
                   "<div><b>" * 20_000 + "</b></div>" * 20_000):
        one = time.perf_counter()
        parse_page(source)
        assert time.perf_counter() - one < 2 or time.perf_counter() - started > 60
    assert isinstance(main_text("<div><b>x" * 5_000, model), str)


def test_closing_follows_the_innermost_open_element():
    tags = lambda source: list(zip(parse_page(source).tags, parse_page(source).parents))
    assert tags("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("#page", -1), ("ul", 0), ("li", 1), ("ul", 2), ("li", 3), ("li", 3), ("li", 1)]
    assert tags("<p>a<div>b</p>c</div>") == [("#page", -1), ("p", 0), ("div", 0)]
    assert tags("<table><tr><td>a<td>b<tr><td>c</table><p>d") == [("#page", -1), ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5), ("p", 0)]
    assert tags("<div><b>x<p>y</b>z</div>w<p>v") == [("#page", -1), ("div", 0), ("p", 1), ("p", 0)]


def test_formulas_drawings_and_fallbacks_of_an_article_stay(model):
    body = (
        "<article><h1>A title of things</h1><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, and it is of some length.</p>"
        "<p>A drawing <svg viewBox='0 0 1 1'><title>of</title><text>a label</text><path d='M0'/></svg> tells about things, and it is of some length.</p>"
        "<noscript><p>Sentence that tells about things without scripts, and it is of some length.</p></noscript>"
        "<object><p>Sentence that tells about an object, and it is of some length.</p></object><template>gone</template><p>End of it.</p></article>"
    )
    source = f"<html><head><title>T</title></head><body><nav><ul><li><a href=#>Home</a></li></ul></nav>{body}<footer>&copy; site words here.</footer></body></html>"
    assert main_text(source, model) == (
        "A title of things The formula x=1 holds, and it is of some length. A drawing ofa label tells about things, and it is of some length. "
        "Sentence that tells about things without scripts, and it is of some length. Sentence that tells about an object, and it is of some length. End of it."
    )


def test_pages_of_a_table(spark, tmp_path, model):
    rows = [(at, f"u{at}", page(at)) for at in range(20)] + [(None, None, None), (5, "again", ""), (5, "again", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_main_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(row.n_chars == len(row.text) for row in found) and sum(row.text == "" for row in found) == 3
    assert extract(frame, model).columns == ["page_id", "url", "text"]
    assert extract(frame.drop("text").withColumn("TEXT", F.lit("clash")), model).columns == ["page_id", "url", "text"]
    assert len({row.text for row in found if row.page_id == 5 and row.url == "again"}) == 1
    frame.limit(0).drop("text").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op9_main_text(spark, f"{tmp_path}/none").collect() == []


def brute(rows, query, count):
    others = [(-float(np.dot(np.asarray(query[1], float), np.asarray(v, float))), i) for i, v in rows if i != query[0]]
    return [(i, -worse) for worse, i in sorted((round(w, 12), i) for w, i in others)[:count]]


def search(spark, rows, schema="vec_id long, embedding array<float>", **more):
    frame = spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash"))
    found: dict[int, list] = {}
    for row in neighbours.nearest(frame, lambda i: i % 20 == 0, **more).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    return found


@pytest.mark.parametrize("sizes", [
    {"SAMPLE_ROWS": 1000, "LEAF_ROWS": 64, "CHUNK_ROWS": 40},
    {"SAMPLE_ROWS": 200, "LEAF_SAMPLE": 50, "LEAF_ROWS": 64, "CHUNK_ROWS": 500, "PART_ROWS": 40, "QUERY_BLOCK": 60, "HOT_QUERIES": 1},
])
def test_recall_and_exact_scores(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(neighbours, name, value)
    chance = np.random.default_rng(2)
    centres = chance.normal(size=(30, 16))
    vectors = (centres[chance.integers(30, size=3000)] + 0.5 * chance.normal(size=(3000, 16))) * chance.uniform(0.5, 2, size=(3000, 1))
    rows = [(at, [float(np.float32(x)) for x in v]) for at, v in enumerate(vectors)]
    got = search(spark, rows)
    hits = 0
    assert len(got) == 150
    for query, found in got.items():
        want = brute(rows, rows[query], 20)
        assert len(found) == 20 and query not in dict(found)
        hits += len(dict(found).keys() & dict(want).keys())
        for vec_id, score in found:
            assert score == pytest.approx(float(np.dot(vectors[query].astype(np.float32).astype(float), np.array(rows[vec_id][1]))), abs=1e-9)
    assert hits / (20 * len(got)) >= 0.9


def test_copies_ties_and_rows_without_part(spark):
    rows = [(at, [1.0, 0.0]) for at in range(0, 60)] + [(100 + at, [float(at % 3), 1.0]) for at in range(30)]
    odd = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan"), 1.0]), (280, [float("inf"), 1.0]), (300, []), (320, [1.0]), (None, [1.0, 1.0])]
    got = search(spark, rows + odd + [(0, [1.0, 0.0])])
    assert set(got) == {0, 20, 40, 100, 120}
    for query in got:
        assert got[query] == brute(rows, dict(rows) and next(row for row in rows if row[0] == query), 20)


def test_few_rows(spark):
    assert search(spark, []) == {} and search(spark, [(20, [1.0])]) == {} and search(spark, [(1, [1.0]), (2, [2.0])]) == {}
    assert search(spark, [(20, [1.0]), (1, [3.0]), (2, [3.0])]) == {20: [(1, 3.0), (2, 3.0)]}
