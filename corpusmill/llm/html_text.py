"""Main text of web pages: a tree-structured graphical model over the DOM, decoded by sum-product messages."""

from __future__ import annotations

import html
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.llm.common import hash_sample, read, ship_package

#: Pages the model is fitted on, none longer than so many bytes, and layouts made from each.
TRAIN_PAGES = 120
TRAIN_PAGE_BYTES = 100_000
LAYOUTS_PER_PAGE = 4
LEAST_LAYOUTS = 300
EPOCHS = 6
LEARNING_RATE = 0.2
SHRINK = 1e-4
FEATURES = 1 << 12

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose text is never shown as text of the page; a title is one outside of the body.
SILENT = frozenset("head script style template".split())
#: Formulas and drawings: all elements inside belong to the line that they lie in.
FOREIGN = frozenset("math svg".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
#: A start tag closes an open element of the set, unless one of the bounds lies between.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
        frozenset({"p"}),
    ),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
BOUNDS = frozenset("article aside blockquote body div footer form header main nav ol section table ul dl".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


@dataclass
class Page:
    """The page's nodes in document order, a parent before its children, and its text in order."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    #: Node and text; None stands for a break inside the node.
    texts: list[tuple[int, str | None]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    #: The node itself if it is a block, else the block that the inline element lies in.
    blocks: list[int] = field(default_factory=list)


class _Builder(HTMLParser):
    """Blocks are nodes, and inline elements that have a class, id or role; other inline elements are part of their block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        #: Tag, node, and whether it is part of a line.
        self.open: list[tuple[str, int, bool]] = []
        #: Places of open elements by tag, of bounds and of all that are no part of a line: looked up instead of walked to.
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = [0]
        self.solid: list[int] = []
        self.silent = self.links = self.foreign = 0
        self._node("#page", False, [])
        self._push("#page", 0, False)

    def _node(self, tag: str, inline: bool, attributes: list[tuple[str, str | None]]) -> int:
        page = self.page
        page.parents.append(self.open[-1][1] if self.open else -1)
        page.tags.append(tag)
        named = " ".join(value or "" for key, value in attributes if key in ("class", "id", "role")).lower()
        page.tokens.append([token.rstrip("s") or token for token in _SPLIT.split(named) if token and not token.isdigit()])
        page.links.append(0)
        node = len(page.tags) - 1
        page.blocks.append(page.blocks[page.parents[node]] if inline else node)
        return node

    def _push(self, tag: str, node: int, inline: bool) -> None:
        at = len(self.open)
        self.open.append((tag, node, inline))
        self.places.setdefault(tag, []).append(at)
        if tag in BOUNDS:
            self.bounds.append(at)
        if not inline:
            self.solid.append(at)
        self.silent += self._hides(tag, at)
        self.links += tag == "a"
        self.foreign += tag in FOREIGN

    def _hides(self, tag: str, at: int) -> bool:
        return tag in SILENT or tag == "title" and self.open[at - 1][0] in ("#page", "html", "head")

    def _pop_to(self, place: int) -> None:
        """Closes all elements from the place on; each is closed once, so a page takes time in proportion to its length."""
        while len(self.open) > place:
            at = len(self.open) - 1
            tag, _, inline = self.open[at]
            self.silent -= self._hides(tag, at)
            self.open.pop()
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
            if not inline:
                self.solid.pop()
            self.links -= tag == "a"
            self.foreign -= tag in FOREIGN

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.page.texts.append((self.open[-1][1], None))
        if tag in VOID:
            return
        if tag not in IN_HEAD and not self.foreign and self.places.get("head"):
            self._pop_to(self.places["head"][-1])
        # The outermost open element it closes, if no bound lies between.
        found = [places[k] for name in CLOSES.get(tag, ()) if (places := self.places.get(name))
                 and (k := bisect_right(places, self.bounds[-1])) < len(places)]
        if found:
            self._pop_to(max(min(found), 1))
        named = any(key in ("class", "id", "role") for key, _ in attrs)
        inline = tag in INLINE or tag in FOREIGN or self.foreign > 0
        node = self.open[-1][1] if inline and not named else self._node(tag, inline, attrs)
        self._push(tag, node, inline)

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        if not places:
            return
        at = places[-1]
        if tag in INLINE and self.solid[-1] > at or tag == "p" and self.bounds[-1] > at:
            return
        self._pop_to(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.foreign and tag not in FOREIGN:
            self.handle_endtag(tag)  # only there a slash closes an element

    def handle_data(self, data: str) -> None:
        if not self.silent and data:
            node = self.open[-1][1]
            self.page.texts.append((node, data))
            if self.links:
                self.page.links[node] += len(data)


def parse_page(source: str) -> Page:
    """The page's tree; any text gives one, however malformed."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.page


def _step(value: float) -> int:
    return int(math.log2(value + 1))


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def node_features(page: Page) -> list[list[int]]:
    """Hashed features of each node: tag, name tokens, amounts of text, links and sentences in it and below it."""
    count = len(page.tags)
    chars, stops = [0] * count, [0] * count
    for node, text in page.texts:
        if text:
            chars[node] += len(text)
            stops[node] += sum(map(text.count, ".!?"))
    below, linked = chars[:], page.links[:]
    for node in range(count - 1, 0, -1):
        below[page.parents[node]] += below[node]
        linked[page.parents[node]] += linked[node]
    whole = max(below[0], 1)
    children: list[set[str]] = [set() for _ in range(count)]
    for node in range(1, count):
        children[page.parents[node]].add(page.tags[node])
    out = []
    for node in range(count):
        tag = page.tags[node]
        names = [f"tag {tag}", f"own {min(_step(chars[node]), 9)}", f"stops {min(stops[node], 4)}"]
        names += [f"name {token}" for token in page.tokens[node]]
        if tag in ("#page", "html", "body"):
            names += [f"{tag} with {child}" for child in sorted(children[node]) or ["nothing"]]
        if below[node]:
            names += [f"linked {tag} {4 * linked[node] // below[node]}", f"part {4 * below[node] // whole}"]
        out.append([_number(name) for name in names])
    return out


class TreeModel:
    """Weights of node features and, by the child's tag, of parent-child label pairs. Label 1 is content."""

    def __init__(self) -> None:
        self.nodes = [0.0] * FEATURES
        self.edges = [[0.0] * 4 for _ in range(FEATURES)]

    def marginals(self, page: Page, features: list[list[int]]) -> tuple[list[float], list[list[float]]]:
        """Per node the probability of content, and those of the four label pairs with its parent.

        Messages go from the leaves to the root and back, each once: exact on a tree. Label 0 has score 0.
        """
        count = len(page.tags)
        ups = [[0.0, sum(self.nodes[f] for f in found)] for found in features]
        sent = [(0.0, 0.0)] * count
        edges = [self.edges[_number(f"edge {tag}")] for tag in page.tags]
        for node in range(count - 1, 0, -1):
            (a, b), e, parent = ups[node], edges[node], page.parents[node]
            message = (_add(a + e[0], b + e[1]), _add(a + e[2], b + e[3]))
            sent[node] = message
            ups[parent][0] += message[0]
            ups[parent][1] += message[1]
        beliefs = [ups[0]] + [[0.0, 0.0]] * (count - 1)
        pairs: list[list[float]] = [[0.0] * 4] * count
        for node in range(1, count):
            (a, b), e, parent = ups[node], edges[node], page.parents[node]
            p0, p1 = beliefs[parent][0] - sent[node][0], beliefs[parent][1] - sent[node][1]
            joint = [p0 + e[0] + a, p0 + e[1] + b, p1 + e[2] + a, p1 + e[3] + b]
            top = max(joint)
            weights = [math.exp(x - top) for x in joint]
            total = sum(weights)
            pairs[node] = [x / total for x in weights]
            beliefs[node] = [_add(p0 + e[0], p1 + e[2]) + a - top, _add(p0 + e[1], p1 + e[3]) + b - top]
        return [_share(b - a) for a, b in beliefs], pairs

    def learn(self, page: Page, features: list[list[int]], labels: list[int], rate: float) -> None:
        """One step up the likelihood of a labelled page."""
        found, pairs = self.marginals(page, features)
        for node, label in enumerate(labels):
            error = rate * (label - found[node])
            for f in features[node]:
                self.nodes[f] += error - rate * SHRINK * self.nodes[f]
            if node:
                e, truth = self.edges[_number(f"edge {page.tags[node]}")], 2 * labels[page.parents[node]] + label
                for k in range(4):
                    e[k] += rate * ((k == truth) - pairs[node][k]) - rate * SHRINK * e[k]


def _add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def _share(value: float) -> float:
    return 1 / (1 + math.exp(-value)) if value > -700 else 0.0


#: The layouts pages are made of for training. Every text of the first list is boilerplate, of the second content.
NAMES = {
    "menu": ("nav", "div menu", "div navbar", "ul nav", "div breadcrumbs", "div navigation", "div toolbar", "div pagination", "div tags"),
    "header": ("header", "div header", "div site-header", "div banner", "div topbar", "div masthead", "div logo"),
    "footer": ("footer", "div footer", "div site-footer", "div copyright", "div bottom", "div credits"),
    "side": ("aside", "div sidebar", "div related", "div widget", "div recommended", "section trending", "div popular", "div author-box"),
    "notice": ("div notice", "div cookie-banner", "div alert", "div popup", "div newsletter", "div consent", "div subscribe", "div modal", "div disclaimer", "div warning", "noscript"),
    "advert": ("div ad", "div ads", "div advert", "div advertisement", "div sponsored", "div promo", "section promotion", "aside sponsor", "p ad"),
    "form": ("form", "form search", "div login", "form signup", "fieldset", "div search-box"),
    "comments": ("section comments", "div comments", "div comment-list", "ol commentlist", "div reader-comments", "div responses", "div replies", "div discussion"),
    "share": ("div share", "div social", "ul social-links", "div sharing"),
}
CONTENT_NAMES = (
    "article", "main", "div content", "div main", "div post-body", "section entry", "div article-body", "div story", "div text",
    "article post", "div page-content", "section",
)


def _open(name: str) -> tuple[str, str]:
    tag, _, label = name.partition(" ")
    return (f'<{tag} class="{label}">' if label else f"<{tag}>"), f"</{tag}>"


def make_layout(sentences: list[str], chance: np.random.Generator) -> str:
    """A page whose content lies in an element marked data-content, with boilerplate before, after and inside.

    Some have no element around their content but the body, some are fragments without any.
    """
    words = " ".join(sentences).split() or ["text"]

    def some(low: int, high: int) -> str:
        at, size = int(chance.integers(len(words))), int(chance.integers(low, high))
        return html.escape(" ".join(words[at : at + size]) or "text")

    def pick(values):
        return values[int(chance.integers(len(values)))]

    def boilerplate(kind: str) -> str:
        start, end = _open(pick(NAMES[kind]))
        if kind in ("menu", "share") or chance.random() < 0.2:
            inner = "".join(f'<li><a href="#">{some(1, 3)}</a></li>' for _ in range(int(chance.integers(2, 8))))
            inner = inner if start.startswith(("<ul", "<ol")) else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f'<label>{some(1, 4)}</label><input name="q"><button>{some(1, 3)}</button>'
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><p>{some(3, 40)}</p></div>' for _ in range(int(chance.integers(1, 5))))
        else:
            inner = pick(("{}", "<p>{}</p>", "<h3>{}</h3><p>{}</p>", "<div><p>{}</p></div>", "<p>{}</p><p>{}</p>"))
            inner = inner.replace("{}", "\0")
            while "\0" in inner:
                inner = inner.replace("\0", some(2, 30), 1)
        return start + inner + end

    def content() -> str:
        kind = chance.random()
        if kind < 0.62:
            return f"<p>{some(1, 60)}</p>"
        if kind < 0.65:
            return some(1, 60)
        if kind < 0.72:
            return f"<p><b>{some(2, 30)}<br><p>{some(1, 30)}</p>"
        if kind < 0.8:
            return f"<h2>{some(1, 8)}</h2><p>{some(5, 40)}</p>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{some(3, 25)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{some(5, 30)}</p></blockquote>"
        if kind < 0.94:
            return f'<p>{some(4, 20)} <a href="#">{some(1, 3)}</a> {some(4, 20)}</p>'
        if kind < 0.955:
            return pick(("<noscript>{}</noscript>", "<object>{}</object>", "<iframe>{}</iframe>")).replace("{}", pick((some(3, 30), f"<p>{some(3, 30)}</p>")))
        if kind < 0.98:
            return f"<figure><figcaption>{some(3, 12)}</figcaption></figure>"
        return f"<table><tr><th>{some(1, 3)}</th><td>{some(1, 6)}</td></tr></table>"

    start, end = _open(pick(CONTENT_NAMES))
    parts = [f"<h1>{some(2, 12)}</h1>"] if chance.random() < 0.8 else []
    for _ in range(int(chance.integers(1, 9))):
        parts.append(content())
        if chance.random() < 0.08:
            parts.append(boilerplate(pick(("advert", "side", "notice", "share"))))
    if chance.random() < 0.15:
        parts.append(boilerplate("comments"))
    busy = 0.4 if chance.random() < 0.8 else 0.05
    before = [boilerplate(k) for k in ("header", "menu", "notice", "advert", "form", "side") if chance.random() < busy]
    after = [boilerplate(k) for k in ("comments", "side", "share", "form", "advert", "menu", "footer") if chance.random() < busy]
    bare = chance.random()
    if bare < 0.1:
        return f"<html><body data-content>{''.join(before + parts + after)}</body></html>"
    if bare < 0.2:
        return FRAGMENT + "".join(before + parts + after)
    if bare < 0.25:
        return FRAGMENT + pick(("", "<p>", "<div>")) + some(1, 60)
    wrap = ("<div class=\"wrapper\">", "</div>") if chance.random() < 0.3 else ("", "")
    marked = start[:-1] + " data-content>"
    return f"<html><body>{wrap[0]}{''.join(before)}{marked}{''.join(parts)}{end}{''.join(after)}{wrap[1]}</body></html>"


#: Starts a fragment that is content as a whole.
FRAGMENT = "<!-- data-content -->"
_MARKED = re.compile(r"<(\w+)([^<>]*?) data-content>")
_BOILERPLATE_TAGS = frozenset("nav header footer aside form fieldset button label".split())
_BOILERPLATE_TOKENS = frozenset(
    token.rstrip("s") or token for names in NAMES.values() for name in names for token in _SPLIT.split(name.partition(" ")[2]) if token
) | {"comment"}


def label_nodes(page: Page, root: int) -> list[int]:
    """Labels of a page that marks its content: 1 below an article, main or marked element, 0 again in boilerplate inside it."""
    labels: list[int] = []
    for node, tag in enumerate(page.tags):
        above = labels[page.parents[node]] if node else root
        if tag in ("article", "main") or "datacontent" in page.tokens[node]:
            labels.append(1)
        elif tag in _BOILERPLATE_TAGS or any(token in _BOILERPLATE_TOKENS for token in page.tokens[node]):
            labels.append(0)
        else:
            labels.append(above)
    return labels


def labelled(source: str) -> tuple[Page, list[int]] | None:
    """A page and its labels, or nothing if it doesn't mark its content."""
    page = parse_page(_MARKED.sub(lambda m: f'<{m[1]}{m[2]} id="datacontent">', source))
    labels = label_nodes(page, int(source.startswith(FRAGMENT)))
    page.tokens = [[token for token in tokens if token != "datacontent"] for tokens in page.tokens]
    return (page, labels) if any(labels) else None


def fit(sources: list[str], seed: int = 9) -> TreeModel:
    """Model from pages that mark their main text by article or main, and from layouts made of their sentences."""
    chance = np.random.default_rng(seed)
    examples = [found for source in sources if (found := labelled(source))]
    sentences = [
        [text for node, text in page.texts if text and labels[node]] for page, labels in examples
    ] or [["Some text of a page."]]
    made = [make_layout(texts, chance) for texts in sentences for _ in range(max(LAYOUTS_PER_PAGE, -(-LEAST_LAYOUTS // len(sentences))))]
    examples += [labelled(source) for source in made]
    ready = [(page, node_features(page), labels) for page, labels in examples]
    model = TreeModel()
    for epoch in range(EPOCHS):
        for at in chance.permutation(len(ready)):
            model.learn(*ready[at], LEARNING_RATE / (1 + epoch))
    return model


def main_text(source: str, model: TreeModel) -> str:
    """Text of the nodes that are content with a probability of at least one half.

    Inline elements join their text, also those that are nodes; breaks and blocks part it; white space runs become one space.
    """
    page = parse_page(source)
    found, _ = model.marginals(page, node_features(page))
    parts: list[str] = []
    last = -1
    for node, text in page.texts:
        if found[node] >= 0.5:
            if page.blocks[node] != last or text is None:
                parts.append(" ")
            parts.append(text or "")
            last = page.blocks[node]
        else:
            last = -1  # words on both sides of what is dropped stay apart
    return " ".join("".join(parts).split())


def fit_pages(pages: DataFrame) -> TreeModel:
    """Model from a bounded sample of pages, in the order of a hash of page_id and html."""
    usable = pages.select("page_id", "html").filter(F.octet_length("html") <= TRAIN_PAGE_BYTES)
    rows = hash_sample(usable, ["page_id", "html"], usable.count(), TRAIN_PAGES).collect()
    return fit([row["html"] for row in rows])


def extract(frame: DataFrame, model: TreeModel, source: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text; a null or empty page has the empty text. ``source`` itself is left out, ``name`` is replaced.

    All other columns are kept. Repeated rows are pages like any other, pages of any length and depth take time in proportion
    to their length, an empty table gives no rows.
    """
    spark = frame.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [column for column in frame.columns if column.lower() not in (source.lower(), name.lower())]
    chosen = frame.select(*[F.col(f"`{column}`") for column in kept], F.col(f"`{source}`"))
    schema = StructType([*chosen.schema[:-1], StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "", shared.value) for value in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*kept, name])

    return chosen.mapInArrow(run, schema)


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, fit_pages(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
