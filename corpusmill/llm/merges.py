"""Exact byte-pair merging of blank-separated chunks with a public tokenizer's vocabulary."""

from __future__ import annotations

import heapq
import json
import os
import struct
import zlib
from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex

from corpusmill.llm.byte_words import Words

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Pieces a worker process remembers before it starts anew.
MEMO_PIECES = 100_000
#: Pieces of more symbols than this are merged with a heap, whose work does not grow with the square of the length.
LONG_PIECE = 200
#: Texts at a time, in bytes: what a task holds besides the batch it was given.
BLOCK_BYTES = 6_000_000

#: Letters below U+0250 without control blanks: no letter there depends on its neighbours when it is normalised.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")
#: Fixed value: the pattern of the tokenizer's words.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def printable_bytes() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {byte: byte for byte in shown} | {byte: 256 + at for at, byte in enumerate(hidden)}


_PRINTABLE = printable_bytes()


class ChunkEncoder:
    """Token ids of chunks, the runs between ASCII white space.

    The tokenizer turns white space into one blank and drops it, and no letter composes with a blank, so a text's ids are
    those of its chunks one after the other. Special tokens are looked for in the chunk as it stands. Pieces of plain chunks
    are cut here; chunks with other letters are normalised and cut by the tokenizer's own steps. Merging is done here for all.
    """

    #: The encoder of this worker process; later tasks find the pieces that earlier ones met.
    shared: dict[int, ChunkEncoder] = {}

    @classmethod
    def of(cls, model: str) -> ChunkEncoder:
        """The process's encoder for a tokenizer file's content."""
        key = zlib.crc32(model.encode())
        if key not in cls.shared:
            cls.shared = {key: cls(model)}
        return cls.shared[key]

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        parts = json.loads(model)
        tokenizer = Tokenizer.from_str(model)
        self.normalize, self.pre_tokenize = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = {token["content"]: token["id"] for token in parts["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self._load(tokenizer, parts["model"])

    def _load(self, tokenizer: Tokenizer, model: dict) -> None:
        """What merging needs of the tokenizer and of the file's part on its model."""
        vocabulary: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.inner = {chr(c): vocabulary[chr(c)] for c in _PRINTABLE.values()}
        self.last = {chr(c): vocabulary[chr(c) + end] for c in _PRINTABLE.values()}
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): at for at, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.memo: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers

    def _merged(self, ids: list[int]) -> list[int]:
        """The lowest-ranked pair, leftmost first, until none is left."""
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at : at + 2] = [made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """As ``_merged``, with the pairs in a heap and symbols in a linked list."""
        rank, made, count = self.rank.get, self.made, len(ids)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(at_rank, at, ids[at], ids[at + 1]) for at in range(count - 1) if (at_rank := rank((ids[at], ids[at + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            least, at, a, b = heapq.heappop(heap)
            right = after[at]
            if ids[at] != a or right >= count or ids[right] != b:
                continue  # one of the two was merged meanwhile
            ids[at], ids[right] = made[least], -1
            after[at] = after[right]
            if after[at] < count:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < count:
                    found = rank((ids[left], ids[after[left]]))
                    if found is not None:
                        heapq.heappush(heap, (found, left, ids[left], ids[after[left]]))
        return [token for token in ids if token >= 0]

    def piece(self, text: str) -> bytes:
        """Ids of one piece, given in the byte-level vocabulary's letters, as little-endian 32-bit numbers."""
        found = self.memo.get(text)
        if found is None:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            ids = [self.inner[letter] for letter in text]
            ids[-1] = self.last[text[-1]]
            ids = self._merged(ids) if len(ids) <= LONG_PIECE else self._merged_long(ids)
            found = self.memo[text] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk as little-endian 32-bit numbers."""
        if "<|" in text:
            parts = self.cut.split(text)
            if len(parts) > 1:
                return b"".join(struct.pack("<I", self.specials[part]) if at % 2 else self.chunk(part) for at, part in enumerate(parts) if part)
        if text.isascii() and text.isalpha():
            return self.piece(text.lower())
        if _PLAIN.fullmatch(text):
            pieces = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_PRINTABLE) for p in _PIECES.findall(text.lower())]
        else:
            pieces = [found for found, _ in self.pre_tokenize(self.normalize(text))]
        return b"".join(map(self.piece, pieces))

    def chunks(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and where each chunk's ids begin (one more entry than chunks)."""
        return joined_ids([self.chunk(text) for text in texts])


def joined_ids(found: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after the other, and where each chunk's ids begin (one more entry than chunks)."""
    first = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(ids) // 4 for ids in found], out=first[1:])
    return np.frombuffer(b"".join(found), "<u4"), first


def row_blocks(texts: pa.Array, block_bytes: int | None = None) -> list[tuple[int, int]]:
    """Consecutive (first row, rows) of about ``block_bytes`` (or BLOCK_BYTES) of text each; a longer text is a block of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // (block_bytes or BLOCK_BYTES)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else np.zeros(1, int)
    return [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]


def ids_of_words(found: Words, codes: np.ndarray, pool: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other and their number per row; word w has the ids ``pool[first[codes[w]]:first[codes[w] + 1]]``."""
    sizes = (first[1:] - first[:-1])[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    ids = pool[np.repeat(first[:-1][codes] - ends[:-1], sizes) + np.arange(ends[-1])]
    bounds = np.zeros(len(found.counts) + 1, np.int64)
    np.cumsum(found.counts, out=bounds[1:])
    return ids, np.diff(ends[bounds])
