"""Fixed-size overlapping character chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import bind


def check_sizes(size: int, overlap: int) -> None:
    if size <= overlap:
        raise ValueError("chunk_size must be greater than overlap")


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    """Chunks of a non-empty text: the last one is the first that reaches the end."""
    step = size - overlap
    beyond = F.ceil((length - F.lit(size)) / F.lit(step))
    return (F.greatest(F.lit(0), beyond) + 1).cast("int")


def fixed_chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of chunks of ``size`` characters, each starting ``size - overlap`` after the one before.

    The text is cut once into steps and every chunk is a step plus the head of what follows, so
    the work stays linear in the text; ``substring`` would walk from the start for every chunk.
    """
    check_sizes(size, overlap)
    step = size - overlap
    following = math.ceil(overlap / step)
    wanted = chunk_count(F.char_length(text), size, overlap)
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def assemble(cut: Column) -> Column:
        def chunk(head: Column, position: Column) -> Column:
            if overlap == 0:
                return head
            tail = F.array_join(F.slice(cut, position + 2, F.lit(following)), "")
            return F.concat(head, F.substring(tail, 1, overlap))

        return F.transform(F.slice(cut, F.lit(1), wanted), chunk)

    return bind(steps, assemble)


def chunk_id(source_path: Column, chunk_index: Column) -> Column:
    """Identity of a chunk, the join key of all retrieval and evaluation operators."""
    return F.concat(source_path, F.lit("::chunk::"), chunk_index.cast("string"))
