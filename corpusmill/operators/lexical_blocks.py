"""Scoring chunks against shipped query terms, block by block.

A join of postings with query terms sends every matching pair of chunk and query through a shuffle.
Here each task scores the chunks it reads and lets only its best pairs per query leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.blocks import SCORED, RunningTopK, by_task, objects
from corpusmill.operators.ranking import SCORE_DIGITS
from corpusmill.session import ship_package


@dataclass
class TaskQueries:
    """Queries of one task: for each key, a vocabulary word asked for under one filter, the queries that use it, with weights.

    Entries are sorted by key; ``entries`` has their places by query and key. Articles and clauses asked for are numbered, ``filters`` are
    the sorted codes of the pairs of both that queries ask for, and ``keys`` those of filter and word. Without filters a key is its word.
    """

    query_ids: np.ndarray
    vocabulary: list[str]
    first: np.ndarray
    query_of: np.ndarray
    weight_of: np.ndarray
    word_of: np.ndarray
    entries: np.ndarray
    entry_first: np.ndarray
    article_values: list[str]
    clause_values: np.ndarray
    filters: np.ndarray
    filter_of: np.ndarray
    keys: np.ndarray
    limits: np.ndarray

    @classmethod
    def of(cls, terms: pd.DataFrame, limit: int = 0) -> "TaskQueries":
        """``limit`` is the number of best chunks of a query without a ``most`` of its own."""
        queries = terms.drop_duplicates("query_id")
        codes = pd.Categorical(terms["query_id"], categories=queries["query_id"]).codes.astype(np.int64)
        words, vocabulary = pd.factorize(terms["term"], sort=True)
        article_numbers, article_values = pd.factorize(queries["article_number"], sort=False)
        clauses = pd.to_numeric(queries["clause_number"], errors="coerce")
        clause_numbers, clause_values = pd.factorize(clauses.astype(float), sort=True)
        filters, filter_of = np.unique((article_numbers + 1) * (len(clause_values) + 1) + clause_numbers + 1, return_inverse=True)
        keys, words = np.unique(filter_of[codes] * len(vocabulary) + words, return_inverse=True)
        order = np.argsort(words, kind="stable")
        counts = np.bincount(words, minlength=len(keys))
        query_of = codes[order]
        limits = np.full(len(queries), limit)
        if "most" in terms.columns:
            own = pd.to_numeric(terms["most"]).fillna(0).groupby(codes).max()
            limits[own.index.to_numpy()] = np.clip(own.to_numpy(dtype=np.int64), 1, limit)
        return cls(
            query_ids=queries["query_id"].to_numpy(dtype=object),
            vocabulary=list(vocabulary),
            first=np.concatenate([[0], np.cumsum(counts)]),
            query_of=query_of,
            weight_of=terms["weight"].to_numpy(dtype=float)[order],
            word_of=np.repeat(np.arange(len(keys)), counts),
            entries=np.argsort(query_of, kind="stable"),
            entry_first=np.concatenate([[0], np.cumsum(np.bincount(query_of, minlength=len(queries)))]),
            article_values=list(article_values),
            clause_values=np.asarray(clause_values, dtype=float),
            filters=filters.astype(np.int64),
            filter_of=filter_of,
            keys=keys,
            limits=limits,
        )

    @property
    def filtered(self) -> bool:
        """Some query asks for an article or a clause."""
        return len(self.filters) > 1 or bool(np.any(self.filters))


def flat_values(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of a list column, the row of each value, and the list lengths."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths), lengths


def counted_terms(analyzed: DataFrame) -> DataFrame:
    """One row per analyzed chunk with its columns, ``dl``, the number of its tokens, and ``terms``, each different token and how often it occurs, by their bytes.

    A chunk whose tokens are null has a null ``dl`` and no terms.
    """
    ship_package(analyzed.sparkSession)
    kept = [name for name in analyzed.columns if name != "tokens"]
    schema = StructType([*[analyzed.schema[name] for name in kept], *StructType.fromDDL("dl int, terms array<struct<term: string, tf: int>>")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, row, lengths = flat_values(batch.column("tokens"))
            coded = token.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            size = max(len(order), 1)
            seen, tf = np.unique(row * size + place[coded.indices.to_numpy()], return_counts=True)
            rows, code = np.divmod(seen, size)
            first = np.searchsorted(rows, np.arange(len(lengths) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([coded.dictionary.take(order).take(pa.array(code)), pa.array(tf, pa.int32())], ["term", "tf"])
            absent = pc.is_null(batch.column("tokens")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], pa.array(lengths, pa.int32(), mask=absent), pa.ListArray.from_arrays(pa.array(first), pairs)],
                schema.names)

    return analyzed.mapInArrow(run, schema)


def term_sums(counted: DataFrame, whole: str) -> DataFrame:
    """term, df, n_tokens of ``counted_terms`` per batch, and under ``whole`` of all its chunks; sums over batches are those of the corpus."""
    ship_package(counted.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("dl").is_valid())
            pair, row, _ = flat_values(batch.column("terms"))
            dl = batch.column("dl").to_numpy().astype(np.int64)
            coded = pair.field("term").dictionary_encode()
            codes, size = coded.indices.to_numpy(), len(coded.dictionary)
            tokens = np.zeros(size, np.int64)
            np.add.at(tokens, codes, dl[row])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([coded.dictionary, pa.array([whole], coded.dictionary.type)]), pa.array(np.append(np.bincount(codes, minlength=size), len(dl))),
                 pa.array(np.append(tokens, dl.sum()))], ["term", "df", "n_tokens"])

    return counted.select("dl", "terms").mapInArrow(run, "term string, df bigint, n_tokens bigint").filter("df > 0")


#: Query entries of postings that are added up at a time, and pairs that are then summed over all words.
BLOCK_ENTRIES = 1_000_000
PAIRS_SUMMED = 100_000
#: A bar is lowered by this, so that rounding never drops a pair that reaches it.
SLACK = 1e-3
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Postings:
    """Chunk, vocabulary word (or key) and value of each posting, sorted by chunk and word."""

    row: np.ndarray
    word: np.ndarray
    value: np.ndarray


#: Codes are added up by address while there are at most so many cells, and this many per code; beyond that they are sorted.
DENSE_CELLS = 1_000_000
CELLS_PER_CODE = 4


def _added(codes: np.ndarray, cells: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, in order, and how often each does, or the sum of its weights in the order given."""
    if cells <= DENSE_CELLS + CELLS_PER_CODE * len(codes):
        counts = np.bincount(codes, minlength=cells)
        found = np.flatnonzero(counts)
        return found, counts[found] if weights is None else np.bincount(codes, weights, cells)[found]
    if weights is None:
        return np.unique(codes, return_counts=True)
    bits = len(codes).bit_length()
    if cells >> (62 - bits):
        found, at = np.unique(codes, return_inverse=True)
        return found, np.bincount(at, weights=weights, minlength=len(found))
    # Sorting codes with their places in the lower bits takes a fraction of the time of sorting places by codes.
    packed = np.sort(codes << bits | np.arange(len(codes)))
    codes = packed >> bits
    new = np.append(True, codes[1:] != codes[:-1])
    return codes[new], np.bincount(np.cumsum(new) - 1, weights[packed & ((1 << bits) - 1)])


def _postings(queries: TaskQueries, words: np.ndarray, rows: np.ndarray, dl: np.ndarray, part: Part) -> Postings:
    """Chunk, word and what the word adds before its weight, in the order of chunks and words; repeated words are counted.

    ``words`` are vocabulary numbers, one per matching token, ``rows`` the chunk of each, in the order of chunks.
    """
    size = max(len(queries.vocabulary), 1)
    least = int(rows[0]) if len(rows) else 0
    used = int(rows[-1]) - least + 1 if len(rows) else 0
    seen, tf = _added((rows - least) * size + words, used * size)
    row, word = np.divmod(seen, size)
    row += least
    return Postings(row, word, part(tf.astype(float), dl[row].astype(float)))


def _counted_postings(queries: TaskQueries, words: np.ndarray, rows: np.ndarray, tf: np.ndarray, dl: np.ndarray, part: Part) -> Postings:
    """As ``_postings`` from terms counted before, each once per chunk."""
    codes = rows * max(len(queries.vocabulary), 1) + words
    if np.any(codes[1:] < codes[:-1]):
        order = np.argsort(codes, kind="stable")
        words, rows, tf = words[order], rows[order], tf[order]
    return Postings(rows, words, part(tf.astype(float), dl[rows].astype(float)))


def _filter_pairs(queries: TaskQueries, article: pa.Array, clauses: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and number of each filter of the queries that the chunk meets, sorted by both."""
    count, clauses_asked = len(article), len(queries.clause_values) + 1
    article = pc.index_in(article, value_set=pa.array(queries.article_values, article.type))
    named = pc.is_valid(article).to_numpy(zero_copy_only=False)
    articles = pc.fill_null(article, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    clause, clause_row, _ = flat_values(clauses)
    value = clause.to_numpy(zero_copy_only=False).astype(float)
    place = np.searchsorted(queries.clause_values, value)
    asked = np.append(queries.clause_values, np.nan)[place] == value
    # A chunk meets its clauses and no clause, each with its article and with none.
    row = np.concatenate([np.arange(count), clause_row[asked]])
    code = np.concatenate([np.zeros(count, np.int64), place[asked] + 1])
    with_article = named[row]
    row, code = np.concatenate([row, row[with_article]]), np.concatenate([code, articles[row[with_article]] * clauses_asked + code[with_article]])
    number = np.minimum(np.searchsorted(queries.filters, code), len(queries.filters) - 1)
    met = queries.filters[number] == code
    return np.divmod(np.unique(row[met] * len(queries.filters) + number[met]), len(queries.filters))


#: Keys are looked up by address while filters and words make at most so many.
KEY_CELLS = 4_000_000


def _keyed(queries: TaskQueries, found: Postings, article: pa.Array, clauses: pa.Array) -> Postings:
    """The postings under each filter that their chunk meets, of the words that queries ask for with it."""
    if not queries.filtered:
        return found
    size = len(queries.vocabulary)
    row, number = _filter_pairs(queries, article, clauses)
    start, stop = np.searchsorted(found.row, row), np.searchsorted(found.row, row, side="right")
    many = stop - start
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
    codes = np.repeat(number, many) * size + found.word[at]
    if size * len(queries.filters) <= KEY_CELLS:
        place = np.full(size * len(queries.filters), -1)
        place[queries.keys] = np.arange(len(queries.keys))
        key = place[codes]
        known = key >= 0
    else:
        key = np.minimum(np.searchsorted(queries.keys, codes), len(queries.keys) - 1)
        known = queries.keys[key] == codes
    return Postings(np.repeat(row, many)[known], key[known], found.value[at[known]])


def _bounds(queries: TaskQueries, found: Postings) -> tuple[np.ndarray, np.ndarray]:
    """Per query entry (by word) what it can add in these postings at most, and that together with all entries of its query that can add less."""
    top = np.zeros(len(queries.keys))
    np.maximum.at(top, found.word, found.value)
    bound = np.abs(queries.weight_of * np.repeat(top, np.diff(queries.first)))
    order = np.lexsort((bound, queries.query_of))
    sums = np.cumsum(bound[order])
    starts = np.flatnonzero(np.diff(queries.query_of[order], prepend=-1))
    before = np.zeros(len(order))
    before[starts] = np.diff(np.concatenate([[0.0], sums[starts] - bound[order][starts]]))
    reach = np.empty(len(order))
    reach[order] = sums - np.cumsum(before)
    return bound, reach


def _cut(found: Postings, at: int, users: np.ndarray) -> int:
    """End of the next block: whole chunks with about BLOCK_ENTRIES query entries, one chunk at least."""
    stop = at + int(np.searchsorted(np.cumsum(users[found.word[at : at + BLOCK_ENTRIES]]), BLOCK_ENTRIES, side="right"))
    if stop < len(found.row):
        first = int(np.searchsorted(found.row, found.row[stop]))
        stop = first if first > at else int(np.searchsorted(found.row, found.row[at], side="right"))
    return stop


def _whole_sums(queries: TaskQueries, found: Postings, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sums over all entries of the pairs' queries, added in the order of words."""
    start, stop = queries.entry_first[query], queries.entry_first[query + 1]
    terms = stop - start
    entry = queries.entries[np.repeat(start - (np.cumsum(terms) - terms), terms) + np.arange(terms.sum())]
    size = len(queries.keys)
    codes = found.row * size + found.word
    asked = np.repeat(row, terms) * size + queries.word_of[entry]
    place = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    added = np.where(codes[place] == asked, found.value[place], 0.0) * queries.weight_of[entry]
    return np.bincount(np.repeat(np.arange(len(row)), terms), added, len(row))


#: Pairs of a filter from which on the entries not looked at are added as a product of matrices, the words of it and its cells at a time.
DENSE_PAIRS = 5_000
DENSE_WORDS = 512
DENSE_CELLS_HELD = 4_000_000
#: Part of the sums over entries not looked at that the words of the product make up, where so few do.
DENSE_SHARE = 0.98
#: Multiplications that take as long as looking up one entry of a pair.
DENSE_WORK = 1000


def _reaching(
    queries: TaskQueries, found: Postings, others: np.ndarray, bound: np.ndarray, row: np.ndarray, query: np.ndarray, sums: np.ndarray, bar: np.ndarray,
) -> np.ndarray:
    """Whether pairs can still reach the bar of their query, where that is known at less cost than by summing them.

    ``sums`` are without the entries ``others``. Those of frequent words are added by a product of chunks by words with words by queries,
    the rest with their bounds, and what single precision may lose is allowed for.
    """
    kept = np.ones(len(row), bool)
    filter_of = queries.filter_of[query]
    for number in np.flatnonzero(np.bincount(filter_of) >= DENSE_PAIRS):
        here = np.flatnonzero(filter_of == number)
        place = np.full(len(queries.query_ids), -1)
        place[query[here]] = 0
        asked = np.flatnonzero(place == 0)
        place[asked] = np.arange(len(asked))
        column = place[query[here]]
        entry = np.flatnonzero(others & (place[queries.query_of] >= 0))
        # Pairs are sorted by chunk.
        line = np.cumsum(np.diff(row[here], prepend=row[here[0]]) != 0)
        rows = row[here[np.append(0, np.flatnonzero(np.diff(line)) + 1)]]
        start, stop = np.searchsorted(found.row, [rows[0], rows[-1] + 1])
        posted = np.searchsorted(rows, found.row[start:stop])
        posted[posted == len(rows)] = 0
        mine = rows[posted] == found.row[start:stop]
        line_of, word, value = posted[mine], found.word[start:stop][mine], found.value[start:stop][mine]
        uses = np.bincount(queries.word_of[entry], minlength=len(queries.keys)) * np.bincount(word, minlength=len(queries.keys))
        words = np.argsort(-uses, kind="stable")[:DENSE_WORDS]
        words = words[: 1 + int(np.searchsorted(np.cumsum(uses[words]), DENSE_SHARE * uses.sum()))]
        many = queries.entry_first[asked + 1] - queries.entry_first[asked]
        if len(rows) * len(asked) * len(words) > DENSE_WORK * int(many[column].sum()):
            continue
        at = np.full(len(queries.keys), -1)
        at[words] = np.arange(len(words))
        dense = at[queries.word_of[entry]] >= 0
        weights = np.zeros((len(words), len(asked)))
        np.add.at(weights, (at[queries.word_of[entry[dense]]], place[queries.query_of[entry[dense]]]), queries.weight_of[entry[dense]])
        weights = weights.astype(np.float32)
        left = np.bincount(place[queries.query_of[entry[~dense]]], bound[entry[~dense]], len(asked))
        whole = np.bincount(place[queries.query_of[entry]], bound[entry], len(asked))
        need = bar[asked] - left - 1e-7 * (many + 8) * whole
        chosen = at[word] >= 0
        line_of, word, value = line_of[chosen], at[word[chosen]], value[chosen]
        step = max(1, DENSE_CELLS_HELD // max(len(asked), len(words)))
        for first in range(0, len(rows), step):
            a, b = np.searchsorted(line_of, [first, first + step])
            values = np.zeros((min(step, len(rows) - first), len(words)), np.float32)
            values[line_of[a:b] - first, word[a:b]] = value[a:b]
            product = values @ weights
            a, b = np.searchsorted(line, [first, first + step])
            kept[here[a:b]] = sums[here[a:b]] + product[line[a:b] - first, column[a:b]] >= need[column[a:b]]
    return kept


def _pairs(queries: TaskQueries, found: Postings, bars: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, query and score of the pairs that share a word, block by block; pairs that can't reach the query's bar may be left out.

    ``bars`` gives the score below which a pair does not count, per query, as it is by then. The entries of a query that can add least
    are not looked at as long as they can't reach its bar together: a chunk that has no other word of the query stays below. What has
    one is summed over all words, so every score that is given is the whole one, added in the same order with any bars.
    """
    if not len(found.row):
        return
    bound, reach = _bounds(queries, found)
    count, at = len(queries.query_ids), 0
    while at < len(found.row):
        bar = bars() - SLACK
        leads = reach >= bar[queries.query_of]
        users = np.bincount(queries.word_of[leads], minlength=len(queries.keys))
        first = np.concatenate([[0], np.cumsum(users)])
        query_of, weight_of = queries.query_of[leads], queries.weight_of[leads]
        rest = np.bincount(queries.query_of[~leads], bound[~leads], count)
        stop = _cut(found, at, users)
        row, word, value = found.row[at:stop], found.word[at:stop], found.value[at:stop]
        at, least, used = stop, int(row[0]), int(row[-1] - row[0]) + 1
        many = users[word]
        entry = np.repeat(first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell, sums = _added(np.repeat(row - least, many) * count + query_of[entry], used * count, np.repeat(value, many) * weight_of[entry])
        row, query = np.divmod(cell, count)
        row += least
        kept = sums + rest[query] >= bar[query]
        row, query, sums = row[kept], query[kept], sums[kept]
        partial = np.flatnonzero(rest[query] > 0)
        if len(partial) >= DENSE_PAIRS:
            reaching = np.ones(len(row), bool)
            reaching[partial] = _reaching(queries, found, ~leads, bound, row[partial], query[partial], sums[partial], bar)
            row, query, sums = row[reaching], query[reaching], sums[reaching]
            partial = np.flatnonzero(rest[query] > 0)
        for start in range(0, len(partial), PAIRS_SUMMED):
            some = partial[start : start + PAIRS_SUMMED]
            sums[some] = _whole_sums(queries, found, row[some], query[some])
        yield row, query, np.round(sums, SCORE_DIGITS)


def score_blocks(
    chunks: DataFrame, terms: pd.DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int,
    bars: dict[str, float] | None = None,
) -> DataFrame:
    """Best pairs of each task as (query_id, chunk_id, score), from chunks with their ``tokens`` or as ``counted_terms`` gives them.

    ``terms(query_id, task, term, weight, article_number, clause_number)`` have been checked to be
    small; with ``most`` a query has a limit of its own. ``part(tf, dl)`` is what a term adds to a score before its weight.
    ``bars`` has scores that so many chunks of a query reach for sure; pairs below are left out.
    """
    ship_package(chunks.sparkSession)
    terms = terms.astype(object).where(terms.notna(), None)
    shipped = {name: TaskQueries.of(own, limit) for name, own in terms.groupby("task")}
    # What no query filters by is not handed to Python.
    filters = ["article_number", "clause_number"] if any(queries.filtered for queries in shipped.values()) else []
    counted = "terms" in chunks.columns
    sure = {name: np.array([(bars or {}).get(query, -np.inf) for query in queries.query_ids]) for name, queries in shipped.items()}
    handle = chunks.sparkSession.sparkContext.broadcast((shipped, sure))

    def offer(best: RunningTopK, queries: TaskQueries, batch: pa.RecordBatch) -> None:
        ids = objects(batch.column("chunk_id"))
        token, token_row, dl = flat_values(batch.column("terms" if counted else "tokens"))
        word = pc.index_in(token.field("term") if counted else token, value_set=pa.array(queries.vocabulary, pa.string()))
        known = pc.is_valid(word).to_numpy(zero_copy_only=False)
        words = pc.fill_null(word, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        if counted:
            dl = pc.fill_null(batch.column("dl"), 0).to_numpy(zero_copy_only=False)
            found = _counted_postings(queries, words, token_row[known], token.field("tf").to_numpy()[known], dl, part)
        else:
            found = _postings(queries, words, token_row[known], dl, part)
        if filters:
            found = _keyed(queries, found, *map(batch.column, filters))
        for row, query, scores in _pairs(queries, found, lambda: best.bars):
            best.add_pairs(query, ids[row], scores)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped, sure = handle.value
        best = {name: RunningTopK(queries.query_ids, queries.limits, sure[name]) for name, queries in shipped.items()}
        for batch in batches:
            for name, rows in by_task(objects(batch.column("task"))).items():
                if name in best:
                    offer(best[name], shipped[name], batch.take(pa.array(rows)) if len(rows) < batch.num_rows else batch)
        for kept in best.values():
            yield kept.result()

    return chunks.select("chunk_id", "task", *filters, *(["dl", "terms"] if counted else ["tokens"])).mapInArrow(run, SCORED)


#: Postings that are read before they are scored.
POSTINGS_READ = 200_000


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True where a value differs from the one before; two nulls don't."""
    codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.diff(codes) != 0


def score_postings(
    posted: DataFrame, terms: pd.DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int
) -> DataFrame:
    """As ``score_blocks``, from postings of the queries' words; others are left out.

    Postings are dealt by chunk, so each is shuffled once however many queries use its word, and the pairs of chunks and queries
    stay in the tasks but for the best. Rows with equal chunk ids are one chunk; each counts for the queries whose filters it meets.
    """
    spark = posted.sparkSession
    ship_package(spark)
    terms = terms.astype(object).where(terms.notna(), None)
    shipped = {name: TaskQueries.of(own, limit) for name, own in terms.groupby("task")}
    filtered = any(queries.filtered for queries in shipped.values())
    # Words are shuffled as numbers, in the order of every task's vocabulary.
    words = sorted(set().union(*[queries.vocabulary for queries in shipped.values()]))
    numbers = {word: number for number, word in enumerate(words)}
    places = {name: np.full(len(words), -1) for name in shipped}
    for name, queries in shipped.items():
        places[name][[numbers[word] for word in queries.vocabulary]] = np.arange(len(queries.vocabulary))
    handle = spark.sparkContext.broadcast((shipped, places))
    # Without filters asked for, what they look at is not shuffled.
    filters = ["article_number", "clause_number"] if filtered else []
    none = F.array().cast("array<bigint>")  # a list column with many nulls is slow to hand to Python
    asked_for = ["article_number", F.coalesce("clause_number", none).alias("clause_number")] if filtered else []
    numbered = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string()), "word": pa.array(range(len(words)), pa.int32())}))
    own = posted.join(F.broadcast(numbered), "term").select("chunk_id", "task", *asked_for, "word", "tf", "dl")
    keys = ["chunk_id", "task", *filters]

    def offer(best: RunningTopK, queries: TaskQueries, place: np.ndarray, rows: pa.Table) -> None:
        word = place[rows.column("word").to_numpy()]
        known = word >= 0
        rows, word = rows.filter(pa.array(known)), word[known]
        if not len(word):
            return
        new = np.any([_changes(pc.binary_join(pc.cast(rows.column(name), pa.list_(pa.string())), ",") if name == "clause_number" else rows.column(name))
                      for name in ("chunk_id", *filters)], axis=0)
        row = np.append(0, np.cumsum(new))
        heads = rows.take(pa.array(np.append(0, np.flatnonzero(new) + 1)))
        ids, size = objects(heads.column("chunk_id")), len(queries.vocabulary)
        value = part(rows.column("tf").to_numpy().astype(float), rows.column("dl").to_numpy().astype(float))
        seen, summed = _added(row * size + word, len(ids) * size, value)
        found = Postings(*np.divmod(seen, size), summed)
        if filtered:
            found = _keyed(queries, found, heads.column("article_number").combine_chunks(), heads.column("clause_number").combine_chunks())
        # Rows of one chunk with different filters are added up, so none of their pairs may go before.
        again = np.flatnonzero(ids[1:] == ids[:-1])
        shared = np.isin(found.row, np.union1d(again, again + 1))
        single = Postings(found.row[~shared], found.word[~shared], found.value[~shared])
        for at, query, scores in _pairs(queries, single, lambda: best.bars):
            best.add_pairs(query, ids[at], scores)
        if shared.any():
            several, none = Postings(found.row[shared], found.word[shared], found.value[shared]), np.full(len(queries.query_ids), -np.inf)
            parts = pd.concat([pd.DataFrame({"query": query, "id": ids[at], "score": scores}) for at, query, scores in _pairs(queries, several, lambda: none)])
            whole = parts.groupby(["query", "id"], as_index=False)["score"].sum()
            best.add_pairs(whole["query"].to_numpy(), whole["id"].to_numpy(dtype=object), np.round(whole["score"].to_numpy(), SCORE_DIGITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped, places = handle.value
        best = {name: RunningTopK(queries.query_ids, queries.limits) for name, queries in shipped.items()}

        def close(rows: pa.Table) -> None:
            for name, queries in shipped.items():
                offer(best[name], queries, places[name], rows.filter(pc.equal(rows.column("task"), name)))

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= POSTINGS_READ:
                rows = pa.Table.from_batches(held)
                # The last chunk may go on in the next batch.
                last = np.flatnonzero(_changes(rows.column("chunk_id")))
                if len(last):
                    close(rows.slice(0, int(last[-1]) + 1))
                    rows = rows.slice(int(last[-1]) + 1)
                held, count = rows.to_batches(), rows.num_rows
        if count:
            close(pa.Table.from_batches(held))
        for kept in best.values():
            yield kept.result()

    # Sorting by a number first costs a fraction of sorting by long strings with common beginnings.
    dealt = own.repartition("chunk_id").withColumn("_chunk", F.xxhash64("chunk_id")).sortWithinPartitions("_chunk", *keys)
    return dealt.select(*keys, "word", "tf", "dl").mapInArrow(run, SCORED)


def queried_postings(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the queries' words only; the words have been checked to be small."""
    return posted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
