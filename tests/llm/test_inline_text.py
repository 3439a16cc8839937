"""Main text around inline elements."""

from __future__ import annotations

from corpusmill.llm.html_text import TreeModel, main_text


class All(TreeModel):
    """Keeps every node but those named drop."""

    def marginals(self, page, features):
        return [float("drop" not in tokens) for tokens in page.tokens], []


def test_classed_inline_elements_join_their_text():
    source = "<p>foo<span class='x'>bar</span>baz, <a class='k'>word</a>.</p><p id=b><i role=x>next</i>one<br>two</p>"
    assert main_text(source, All()) == "foobarbaz, word. nextone two"


def test_blocks_and_dropped_elements_part_text():
    assert main_text("<div>a<p class=x>b</p>c<span class=drop>no</span>d<a class=k><div>e</div>f</a></div>", All()) == "a b c d e f"
