"""Spelling variants: words one edit apart, found by scanning sorted lists with banded edit rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, ship_package, stored

#: Letters of a word; the smallest code point above all of them ends a range of words with a common beginning.
RUN = r"[A-Za-zÀ-ÿ]+"
BEYOND = "Ā"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times as frequent a form has to be.
TIMES = 5
#: One run in so many loses a letter before it is counted.
MISSPELT = 199
#: Words of a sorted list that one task scans.
LIST_WORDS = 20_000


def runs(text: Column) -> Column:
    """Maximal letter runs of a text with A-Z in lower case; null texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))


def vocabulary(frame: DataFrame, identity: str = "doc_id", text: str = "text", misspelt: int | None = MISSPELT,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: all words of at least ``least_length`` code points that occur at least ``least_count`` times.

    With ``misspelt``, a run whose CRC-32 with its row's id (a null id is empty) is divisible by it first loses one code point.
    Occurrences are added up in each task before any is sent on.
    """
    run = F.col("run")
    each = frame.select(F.coalesce(F.col(f"`{identity}`").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col(f"`{text}`"))).alias("run"))
    if misspelt:
        each = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
        place = F.pmod(F.col("h"), F.char_length(run).cast("long")).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
        each = each.select(F.when(F.col("h") % misspelt == 0, cut).otherwise(run).alias("run"))
    return each.filter(F.char_length("run") >= least_length).groupBy(run.alias("word")).agg(F.count("*").alias("n")).filter(
        F.col("n") >= least_count)


def scan(words: list[str], asked: list[str], shared: int) -> list[int]:
    """Indexes of all words of the sorted list that begin with the first ``shared`` letters of ``asked`` and are one edit from it.

    ``asked`` is the text itself. Each prefix of a listed word has one row of the edit matrix, of which a distance of one needs
    three cells around the diagonal. Consecutive words keep the rows of their common prefix. Where a row has no cell
    below two, no word with that prefix can be near, so the scan goes on behind all of them.
    """
    size = len(asked)
    at = bisect_left(words, asked[:shared])
    end = bisect_left(words, asked[:shared] + BEYOND, at)
    padded = asked + BEYOND * 2  # cells beyond the text never match
    rows = [(2, 0, 1)] * (size + 3)
    # After an equal beginning of d letters: one letter less, as many, one more of the asked text.
    rows[shared] = (1, 0, 1) if shared else (2, 0, 1)
    found = []
    depth = shared  # rows up to here belong to the word looked at last
    last = ""
    while at < end:
        word = words[at]
        length = len(word)
        if last:
            same = shared
            most = min(depth, length)
            while same < most and word[same] == last[same]:
                same += 1
            depth = same
        a, b, c = rows[depth]
        dead = False
        while depth < length:
            if depth > size:  # two letters longer than the text
                dead = True
                break
            letter = word[depth]
            if depth and letter != padded[depth - 1]:
                a += 1
            elif not depth:
                a = 1
            if b + 1 < a:
                a = b + 1
            if letter != padded[depth]:
                b += 1
            if c + 1 < b:
                b = c + 1
            if a + 1 < b:
                b = a + 1
            if letter != padded[depth + 1]:
                c += 1
            if b + 1 < c:
                c = b + 1
            depth += 1
            rows[depth] = (a, b, c)
            if a > 1 and b > 1 and c > 1:
                dead = True
                break
        last = word
        if dead:
            at = bisect_left(words, word[:depth] + BEYOND, at + 1, end) if depth < length else at + 1
            continue
        # The cell of the whole text, if it lies within the band of the word's last row.
        over = size - length
        if -1 <= over <= 1 and rows[length][over + 1] == 1:
            found.append(at)
        at += 1
    return found


#: Letters of a list's ends that are kept to send words to it, words that ask one copy of a list.
ENDS = 64
ASKING_WORDS = 40_000


def _sides(words: DataFrame) -> DataFrame:
    """Each word twice: as it is and from its end."""
    return words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").unionByName(
        words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))


def _shared(side: int, size: int) -> int:
    """Letters that a word of this size has in common with a near one at its beginning, or else at its end."""
    return size // 2 if side == 0 else size - size // 2


def _asking(bounds: dict[int, tuple[list[int], list[str], list[str]]]):
    """Sends each key to all lists that may hold words with its beginning. ``bounds``: per side the lists, their first and last keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = [], []
            for at, (side, key) in enumerate(zip(batch.column("side").to_pylist(), batch.column("key").to_pylist())):
                numbers, first, last = bounds[side]
                begin = key[: _shared(side, len(key))][:ENDS]
                a, b = bisect_left(last, begin), bisect_left(first, begin + BEYOND)
                rows += [at] * (b - a)
                lists += numbers[a:b]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *taken.columns], ["list", "side", "key", "n"])

    return run


def _scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (list, part) after (list, part): first the list's words in order, then the words that ask."""
    current, words, counts = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(name).to_numpy() for name in ("list", "part", "asks")]
        cuts = np.flatnonzero(np.any([np.diff(mark) != 0 for mark in marks], axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            place = (int(marks[0][start]), int(marks[1][start]))
            if place != current:
                current, words, counts = place, [], []
            part = batch.slice(start, stop - start)
            keys, numbers = part.column("key").to_pylist(), part.column("n").to_pylist()
            if not marks[2][start]:
                words += keys
                counts += numbers
                continue
            side = part.column("side")[0].as_py()
            near, best_n, best = [], [], []
            for key in keys:
                shared = _shared(side, len(key))
                found = scan(words, key, shared)
                if side and found:
                    # Near words that also share the beginning are found on the other side.
                    tail = key[shared:]
                    found = [at for at in found if not words[at].endswith(tail)]
                near.append(len(found))
                top = min(((-counts[at], words[at][::-1] if side else words[at]) for at in found), default=(None, None))
                best_n.append(top[0])
                best.append(top[1])
            if side:
                keys = [key[::-1] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), part.column("n"), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
                ["word", "n", "n_near", "less_n", "form"],
            )


def near_words(words: DataFrame, list_words: int = LIST_WORDS, asking_words: int = ASKING_WORDS) -> DataFrame:
    """word, n, n_near, best, best_n from different words with counts (word, n): the words one edit away and the most frequent of them.

    The vocabulary is sorted twice, by its words and by its words read backwards, and cut into lists of about ``list_words``.
    An edit leaves one half of a word alone, so a word asks the lists with its beginning in one order and those with its
    end in the other: one or two, or all lists of a very common beginning. A list asked by more than ``asking_words``
    words is copied, so that no task scans for more. The driver receives the ends and sizes of the lists.
    """
    spark = words.sparkSession
    ship_package(spark)
    total = words.count()
    if not total:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    lists = -(-2 * total // list_words)
    listed = stored(_sides(words).repartitionByRange(lists, "side", "key").withColumn("list", 2 * F.spark_partition_id() + F.col("side")), "spelling-lists")
    ends = listed.groupBy("side", "list").agg(F.substring(F.min("key"), 1, ENDS).alias("first"), F.substring(F.max("key"), 1, ENDS).alias("last"))
    bounds: dict[int, tuple[list[int], list[str], list[str]]] = {}
    for side in (0, 1):
        found = sorted((row for row in ends.collect() if row["side"] == side), key=lambda row: (row["first"], row["last"], row["list"]))
        # A cut key stands for all that begin with it.
        bounds[side] = ([row["list"] for row in found], [row["first"] for row in found], [row["last"] + BEYOND * (len(row["last"]) == ENDS) for row in found])
    asking = stored(listed.select("side", "key", "n").mapInArrow(_asking(bounds), "list int, side int, key string, n long"), "spelling-asking")
    parts = asking.groupBy("list").agg(F.ceil(F.count("*") / asking_words).cast("int").alias("parts"))
    copied = listed.join(F.broadcast(parts), "list").select(
        "list", "side", "key", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"))
    dealt = asking.join(F.broadcast(parts), "list").select(
        "list", "side", "key", "n", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("asks"))
    both = copied.unionByName(dealt).repartition(max(lists, 1), "list", "part").sortWithinPartitions("list", "part", "asks", "key")
    found = both.mapInArrow(_scanning, "word string, n long, n_near long, less_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("less_n", "form")))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n", "n_near", F.col("top.form").alias("best"), (-F.col("top.less_n")).alias("best_n"))


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from word to word ends, for links (word, form) without circles.

    Each round replaces a root by that root's own, so rounds grow with the logarithm of the longest way; each is written.
    """
    roots = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = stored(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        roots = joined.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n from a vocabulary of different words (word, n).

    A word's form is its most frequent near word (ties: the smallest), if that is at least ``times`` as frequent. Words without
    near ones have none and are their own root. Null words and repeated rows are no vocabulary; other columns are
    not read. An empty vocabulary gives no rows.
    """
    near = near_words(words.select("word", "n"))
    good = F.col("best_n") >= times * F.col("n")
    formed = stored(near.select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = last_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Variants among the words of all documents."""
    return variants(stored(vocabulary(read(spark, folder, "documents")), "vocabulary"))
