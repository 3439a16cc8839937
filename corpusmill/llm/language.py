"""Language of words in possibly code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusmill.llm.common import fresh, read, ship_package
from corpusmill.session import fits_broadcast

UNKNOWN = "und"
#: The background class of a field that also learns what no language is, and the share of a text's words from which on the text is rejected.
BACKGROUND = "\0background"
MOST_BACKGROUND = 0.5

#: Documents per language the model is fitted on, and pieces of PIECE_WORDS words taken from each, spread evenly over it.
TRAIN_DOCUMENTS = 400
TRAIN_PIECES = 8
PIECE_WORDS = 12
#: Pieces of the same or other documents joined to one training chain, so that switches between languages are seen.
CHAIN_PIECES = 4
EPOCHS = 3
BATCH_CHAINS = 128
LEARNING_RATE = 0.3

#: Scored words a task remembers before it starts anew.
MEMO_WORDS = 150_000

FEATURES = 1 << 16
NGRAMS = (1, 2, 3, 4)
AFFIXES = (1, 2, 3, 4)
LEXICON_WORDS = 1000

_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(token: str) -> str:
    """The token's letters in lower case."""
    return _NO_LETTER.sub("", token.lower())


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words and the word each belongs to: character n-grams, prefixes, suffixes, lexicon.

    N-grams and affixes are hashed to FEATURES numbers, lexicon words follow them. Words are handled in groups
    of like length, each as a matrix of code points.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    numbers, owners = [], []
    classes = np.ceil(np.log2(np.maximum(sizes, 4))).astype(np.int64)
    for width_class in np.unique(classes):
        rows = np.nonzero((classes == width_class) & (sizes > 0))[0]
        if not len(rows):
            continue
        width = 1 << int(width_class)
        points = np.array([words[row] for row in rows], dtype=f"<U{width}").view(np.uint32).reshape(len(rows), width).astype(np.uint64)
        size = sizes[rows]
        places = np.arange(width)
        rolled = np.zeros_like(points)
        for n in range(1, max(*NGRAMS, *AFFIXES) + 1):
            rolled = rolled[:, : width - n + 1] * np.uint64(1_000_003) + points[:, n - 1 :]
            valid = places[None, : width - n + 1] <= (size - n)[:, None]

            def add(kind: int, hashes: np.ndarray, who: np.ndarray) -> None:
                mixed = (hashes + np.uint64(kind * 16 + n)) * np.uint64(0x9E3779B97F4A7C15)
                numbers.append((mixed >> np.uint64(40)).astype(np.int64) % FEATURES)
                owners.append(who)

            if n in NGRAMS:
                at, place = np.nonzero(valid)
                add(1, rolled[at, place], rows[at])
            if n in AFFIXES:
                some = np.nonzero(size >= n)[0]
                add(2, rolled[some, 0], rows[some])
                add(3, rolled[some, size[some] - n], rows[some])
    known = [(at, lexicon[word]) for at, word in enumerate(words) if word in lexicon]
    if known:
        owners.append(np.array([at for at, _ in known]))
        numbers.append(np.array([FEATURES + number for _, number in known]))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(owners)


@dataclass
class Field:
    """A linear chain over words: feature weights per language, transitions, start scores."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray = field(init=False)
    transitions: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        count = len(self.languages)
        self.weights = np.zeros((FEATURES + len(self.lexicon), count), np.float32)
        self.transitions = np.zeros((count, count), np.float32)
        self.starts = np.zeros(count, np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every language for each word."""
        numbers, owners = word_features(words, self.lexicon)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(len(self.languages)):
            out[:, at] = np.bincount(owners, self.weights[numbers, at], len(words))
        return out

    def marginals(self, scores: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over chains (chain, place, language); places after a chain's end are not valid.

        Gives the marginals of words, the summed marginals of neighbouring pairs and those of first words. Messages are
        normalised at each place, so chains of any length stay within the range of numbers.
        """
        chains, places, count = scores.shape
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max())
        forward = np.empty_like(local)
        forward[:, 0] = local[:, 0] * np.exp(self.starts - self.starts.max())
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, places):
            here = (forward[:, t - 1] @ step) * local[:, t]
            here /= here.sum(axis=1, keepdims=True)
            forward[:, t] = np.where(valid[:, t, None], here, forward[:, t - 1])
        backward = np.ones_like(local)
        pairs = np.zeros((count, count))
        for t in range(places - 2, -1, -1):
            ahead = local[:, t + 1] * backward[:, t + 1]
            both = forward[:, t, :, None] * step[None] * ahead[:, None, :]
            both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-30)
            pairs += both[valid[:, t + 1]].sum(axis=0)
            before = ahead @ step.T
            before /= np.maximum(before.sum(axis=1, keepdims=True), 1e-30)
            backward[:, t] = np.where(valid[:, t + 1, None], before, backward[:, t])
        both = forward * backward
        both /= np.maximum(both.sum(axis=2, keepdims=True), 1e-30)
        return both, pairs, both[:, 0].sum(axis=0)

    def word_marginals(self, scores: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Marginals of consecutive words; ``owners`` says which text a word belongs to. A text is one chain from its first word to its last.

        Texts go through their words side by side, longest first, so that the texts still running at a place are the first ones: the
        scores lie ordered by place and no room is spent on texts that have ended.
        """
        total = len(owners)
        if not total:
            return np.empty_like(scores)
        first = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1, [total]])
        sizes = np.diff(first)
        by_size = np.argsort(-sizes, kind="stable")
        running = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), side="right")  # texts that have a word at a place
        at = np.concatenate([[0], np.cumsum(running)])
        nth = np.empty(len(sizes), np.int64)
        nth[by_size] = np.arange(len(sizes))
        place = at[np.arange(total) - np.repeat(first[:-1], sizes)] + np.repeat(nth, sizes)
        local = np.empty(scores.shape, np.float32)
        local[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        forward = np.empty_like(local)
        here = local[: running[0]] * np.exp(self.starts - self.starts.max())
        forward[: running[0]] = here / here.sum(axis=1, keepdims=True)
        for t in range(1, len(running)):
            here = (forward[at[t - 1] : at[t - 1] + running[t]] @ step) * local[at[t] : at[t + 1]]
            here /= here.sum(axis=1, keepdims=True)
            forward[at[t] : at[t + 1]] = here
        back = step.T.copy()
        message = np.ones((running[-1], scores.shape[1]), np.float32)
        for t in range(len(running) - 2, -1, -1):
            before = np.ones((running[t], scores.shape[1]), np.float32)
            ahead = (local[at[t + 1] : at[t + 2]] * message) @ back
            before[: running[t + 1]] = ahead / ahead.sum(axis=1, keepdims=True)
            forward[at[t] : at[t + 1]] *= before
            message = before
        forward /= forward.sum(axis=1, keepdims=True)
        return forward[place]


def background_pieces(pieces: list[tuple[str, list[str]]], seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pieces of no language: of every second given one the words with their letters in another order or drawn evenly from all letters met."""
    chance = random.Random(seed)
    alphabet = sorted({letter for _, words in pieces for word in words for letter in letters(word)})
    out = []
    for _, words in pieces[::2]:
        made = []
        for word in filter(None, map(letters, words)):
            drawn = chance.random() < 0.5
            made.append("".join(chance.choices(alphabet, k=chance.randrange(2, 10)) if drawn else chance.sample(word, len(word))))
        out.append((BACKGROUND, made))
    return out


def fit(pieces: list[tuple[str, list[str]]], seed: int = 2) -> Field | None:
    """Model from (language, words) pieces by gradient ascent on the chains' log-likelihood."""
    pieces = [(language, [w for w in map(letters, words) if w]) for language, words in pieces]
    pieces = [(language, words) for language, words in pieces if words]
    languages = sorted({language for language, _ in pieces})
    if not languages:
        return None
    counts: dict[str, Counter] = {language: Counter() for language in languages}
    for language, words in pieces:
        counts[language].update(words)
    common = {w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS] if n > 2}
    model = Field(languages, {word: at for at, word in enumerate(sorted(common))})
    vocabulary = {word: at for at, word in enumerate(sorted({w for _, words in pieces for w in words}))}
    numbers, owners = word_features(list(vocabulary), model.lexicon)
    by_owner = np.argsort(owners, kind="stable")
    numbers, spans = numbers[by_owner], np.searchsorted(owners[by_owner], np.arange(len(vocabulary) + 1))
    coded = [(languages.index(language), [vocabulary[w] for w in words]) for language, words in pieces]
    chance = np.random.default_rng(seed)
    power_w, power_t, power_s = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6), np.full_like(model.starts, 1e-6)
    for _ in range(EPOCHS):
        # Runs of pieces keep their language for a while and then switch, as mixed texts do.
        order = chance.permutation(len(coded))
        keep = chance.random(len(coded)) < 0.7
        pools: dict[int, list[int]] = {}
        for at in order:
            pools.setdefault(coded[at][0], []).append(int(at))
        sequence, language = [], coded[order[0]][0]
        for stay in keep:
            if not stay or not pools.get(language):
                open_pools = [k for k, v in pools.items() if v]
                sizes = np.array([len(pools[k]) for k in open_pools], float)
                language = int(chance.choice(open_pools, p=sizes / sizes.sum()))
            sequence.append(pools[language].pop())
        chains = [sequence[at : at + CHAIN_PIECES] for at in range(0, len(sequence), CHAIN_PIECES)]
        for at in range(0, len(chains), BATCH_CHAINS):
            batch = chains[at : at + BATCH_CHAINS]
            words = [[w for p in chain for w in coded[p][1]] for chain in batch]
            truth = [[coded[p][0] for p in chain for _ in coded[p][1]] for chain in batch]
            longest = max(map(len, words))
            valid = np.array([[t < len(w) for t in range(longest)] for w in words])
            word_at, label_at = np.zeros(valid.shape, np.int64), np.zeros(valid.shape, np.int64)
            for row, (w, y) in enumerate(zip(words, truth)):
                word_at[row, : len(w)], label_at[row, : len(y)] = w, y
            used, place = np.unique(word_at, return_inverse=True)
            lengths = spans[used + 1] - spans[used]
            feature_at = np.concatenate([numbers[spans[u] : spans[u + 1]] for u in used])
            owner_at = np.repeat(np.arange(len(used)), lengths)
            count = len(languages)
            scores = np.stack([np.bincount(owner_at, model.weights[feature_at, k], len(used)) for k in range(count)], axis=1)
            found, pairs, firsts = model.marginals(scores[place.reshape(valid.shape)], valid)
            wanted = np.eye(count)[label_at]
            error = (wanted - found)[valid]
            per_word = np.stack([np.bincount(place.reshape(valid.shape)[valid], error[:, k], len(used)) for k in range(count)], axis=1)
            seen = np.zeros((count, count))
            both = valid[:, 1:]
            np.add.at(seen, (label_at[:, :-1][both], label_at[:, 1:][both]), 1)
            touched, where = np.unique(feature_at, return_inverse=True)
            ascent = np.stack([np.bincount(where, per_word[owner_at, k], len(touched)) for k in range(count)], axis=1) / len(batch)
            power_w[touched] += ascent**2
            model.weights[touched] += LEARNING_RATE * ascent / np.sqrt(power_w[touched])
            ascent_t = (seen - pairs) / len(batch)
            power_t += ascent_t**2
            model.transitions += LEARNING_RATE * ascent_t / np.sqrt(power_t)
            ascent_s = (np.bincount(label_at[:, 0], minlength=count) - firsts) / len(batch)
            power_s += ascent_s**2
            model.starts += LEARNING_RATE * ascent_s / np.sqrt(power_s)
    return model


def training_pieces(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS) -> list[tuple[str, list[str]]]:
    """A bounded sample of pieces from rows of doc_id, text and lang: at most ``documents`` texts per language.

    Texts are taken in the order of a hash of doc_id and text, so that the sample depends on the rows only. Repeated rows count
    once: what has the same hash is cut to one row before it is sent.
    """
    chance = (F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5).alias("chance")
    counts = labelled.select("lang", chance).distinct().groupBy("lang").count()
    # Three times the expected share, then cut exactly by rank among the few that are left.
    few = labelled.select("lang", "text", chance).join(F.broadcast(counts) if fits_broadcast(counts) else counts, "lang").filter(F.col("chance") * F.col("count") < 3 * documents)
    few = few.groupBy("lang", "chance").agg(F.first("text").alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for language, text, chance in zip(frame["lang"], frame["text"], frame["chance"]):
                words = text.split()
                count = len(words) // PIECE_WORDS or 1
                for at in sorted({count * k // TRAIN_PIECES for k in range(TRAIN_PIECES)}):
                    rows.append((language, chance, " ".join(words[at * PIECE_WORDS : (at + 1) * PIECE_WORDS])))
            yield pd.DataFrame(rows, columns=["lang", "chance", "piece"])

    rows = few.select("lang", "text", "chance").mapInPandas(cut, "lang string, chance double, piece string").collect()
    ranked: dict[str, dict[float, list[str]]] = {}
    for row in sorted(rows):
        ranked.setdefault(row["lang"], {}).setdefault(row["chance"], []).append(row["piece"])
    return [
        (language, piece.split()) for language, texts in ranked.items()
        for chance in sorted(texts)[:documents] for piece in texts[chance]
    ]


def identify(frame: DataFrame, model: Field | None, text: str = "text", keep_text: bool = True,
             added: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score to a frame.

    Every word of the whole text is labelled by forward-backward over one chain; the language with the largest sum of word
    marginals is the text's, its share of the sum the score. ``und`` and 0 for a null text, one without any
    letter, or without a model. A background class is never predicted; a third name in ``added`` gets its share of the sum. Columns of the frame
    named like ``added`` are replaced, all others kept, the text only with ``keep_text``. Repeated rows are predicted alike; a text of any
    length is one chain, whose messages take about a hundred bytes a word. An empty table gives no rows.
    """
    spark = frame.sparkSession
    ship_package(spark)
    kept = [column for column in frame.columns if column.lower() not in map(str.lower, added)]
    shared = spark.sparkContext.broadcast(model)
    source = frame.select(*[F.col(f"`{column}`") for column in kept])
    passed = [at for at, column in enumerate(kept) if keep_text or column != text]
    names = [kept[at] for at in passed]
    schema = StructType([*[source.schema[at] for at in passed], StructField(added[0], StringType()), *[StructField(name, DoubleType()) for name in added[1:]]])
    text_at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _Labeller(shared.value)
        for batch in batches:
            predicted, *scores = label(batch.column(text_at), background=len(added) > 2)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at) for at in passed], pa.array(predicted, pa.string()), *[pa.array(found, pa.float64()) for found in scores]],
                [*names, *added],
            )

    return source.mapInArrow(run, schema)


class _Labeller:
    """Labels the texts of batches; remembers the scores of a bounded number of tokens."""

    #: Tokens after which the texts met are computed. A text is never cut, so a longer one is computed as a whole.
    BLOCK_TOKENS = 300_000

    def __init__(self, model: Field | None) -> None:
        self.model = model
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages) if model else 0), np.float32)

    def _codes(self, tokens: list[str]) -> np.ndarray:
        """Row of each token in the score table, -1 for one without letters."""
        memo = self.memo
        new = list({token for token in tokens if token not in memo})
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                self.scores = self.scores[:0]
                new = list(set(tokens))
            cores = [letters(token) for token in new]
            some = [at for at, core in enumerate(cores) if core]
            base = len(self.scores)
            self.scores = np.concatenate([self.scores, self.model.emissions([cores[at] for at in some])])
            memo.update(dict.fromkeys(new, -1))
            memo.update({new[at]: base + k for k, at in enumerate(some)})
        return np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, column: pa.Array, background: bool = False) -> tuple[list[str], *tuple[np.ndarray, ...]]:
        rows = len(column)
        if self.model is None:
            return [UNKNOWN] * rows, *[np.zeros(rows)] * (1 + background)
        sums = np.zeros((rows, len(self.model.languages)))
        tokens, owners, held = [], [], 0

        def flush() -> None:
            nonlocal tokens, owners, held
            flat = [token for part in tokens for token in part]
            codes = self._codes(flat)
            owner = np.repeat(owners, [len(part) for part in tokens])[codes >= 0]
            found = self.model.word_marginals(self.scores[codes[codes >= 0]], owner)
            for at in range(sums.shape[1]):
                sums[:, at] += np.bincount(owner, found[:, at], rows)
            tokens, owners, held = [], [], 0

        for row, value in enumerate(column):
            parts = (value.as_py() or "").split()
            if parts:
                tokens.append(parts)
                owners.append(row)
                held += len(parts)
            if held >= self.BLOCK_TOKENS:
                flush()
        if tokens:
            flush()
        total = sums.sum(axis=1)
        none = [name == BACKGROUND for name in self.model.languages]
        best = np.where(none, -1.0, sums).argmax(axis=1)
        names = [self.model.languages[k] if n > 0 else UNKNOWN for k, n in zip(best, total)]
        parts = [sums[np.arange(rows), best], *[sums[:, none].sum(axis=1)] * background]
        return names, *[np.where(total > 0, part / np.maximum(total, 1e-30), 0.0).clip(0, 1) for part in parts]


def held_out(identity: str = "doc_id") -> Column:
    """True for the fifth of documents that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(identity).cast("string"), F.lit(""))) % 5 == 0


def fit_documents(documents: DataFrame, background: bool = False) -> Field | None:
    """Model from the documents that may be learned from, on request with a background class. Reads doc_id, text and lang."""
    ship_package(documents.sparkSession)
    usable = documents.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pieces = training_pieces(usable)
    return fit(pieces + background_pieces(pieces) if background else pieces)


def in_known_language(documents: DataFrame, most_background: float = MOST_BACKGROUND) -> DataFrame:
    """Documents in known languages: not ``und``, and less than ``most_background`` of their words, by marginals, of no language.

    The field has a class for words of no language, learned from shuffled and random letters, so its verdict does not depend on how many languages there are
    and a document that switches between languages stays. All columns are kept; a null ``lang`` is replaced by the predicted language.
    """
    added = tuple(fresh(documents, name) for name in ("_language", "_language_score", "_language_background"))
    found = identify(documents, fit_documents(documents, background=True), added=added)
    kept = found.filter((F.col(added[0]) != UNKNOWN) & (F.col(added[2]) < most_background))
    return kept.withColumn("lang", F.coalesce("lang", added[0])).select(*[F.col(f"`{column}`") for column in documents.columns])


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document: doc_id, held_out, lang_pred, score."""
    documents = read(spark, folder, "documents")
    model = fit_documents(documents)
    return identify(documents.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)
