"""Words of many texts at once, found on the bytes of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ASCII white space; bytes of longer UTF-8 characters are never among it.
BLANK_BYTES = b" \t\n\x0b\x0c\r"


@dataclass
class Words:
    """Words in text order, the row of each, the words of each row and, per word, whether a mark or a text's start lies before it."""

    words: pa.LargeStringArray
    row: np.ndarray
    counts: np.ndarray
    opens: np.ndarray


def _marked(which: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(which)] = True
    return table


def split_words(texts: pa.Array, blanks: bytes = BLANK_BYTES, marks: bytes = b"", after_letter: bytes = b"") -> Words:
    """Maximal runs of bytes that are neither ``blanks`` nor ``marks``, both ASCII. Null texts are empty, empty ones have no words.

    A byte of ``after_letter`` behind an ASCII letter begins a word of its own.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1] if rows else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    starts_row = offsets[:-1] - first
    inside = _marked(blanks + marks)[data] == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if after_letter:
        letter = (data[:-1] | 32) - np.uint8(97) < 26
        begins[1:] |= _marked(after_letter)[data[1:]] & letter
    row_starts = starts_row[starts_row < len(data)]
    begins[row_starts] = inside[row_starts]  # a word never goes on from the text before
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    cuts = row_starts[row_starts > 0] - 1
    ends[cuts] = inside[cuts]
    # Without what is between them, words are consecutive slices.
    places = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - start, out=places[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[inside]))
    counts = np.diff(np.searchsorted(start, offsets - first))
    row = np.repeat(np.arange(rows), counts)
    opens = np.ones(len(start), bool)
    if len(start) > 1:
        opens[1:] = row[1:] != row[:-1]
        if marks:
            after = np.searchsorted(start, np.flatnonzero(_marked(marks)[data]))
            opens[after[after < len(start)]] = True
    return Words(words, row, counts, opens)
