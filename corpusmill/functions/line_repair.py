"""Joining words that text extraction has split, line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import LINE_END, bind

# Short words that never count as fragments of a longer one.
WHOLE_WORDS = (
    "a", "an", "are", "as", "at", "be", "by", "do", "for", "he", "if", "in", "is", "and", "is", "it",
    "of", "on", "or", "that", "the", "this", "those", "these", "to", "us", "was", "we", "were", "when", "with",
)

#: Around the core of a token, which runs from its first letter to its last letter or hyphen.
_AROUND_CORE = r"(?<![^ \n])[^A-Za-z \n]+|[^A-Za-z\- \n]+(?![^ \n])"

# One mark per token. Plain cores of 1, 2, 3, 4 and more letters are 1 to 5, cores of 2, 3, 4 and more
# that end in a hyphen are 6 to 9, "or" is @, other whole words are 0 or, from 4 letters on, %. Tokens
# without a core are _, line ends stand for themselves.
_JOINED = "|".join(
    [
        "([234678]) ([126@]) ([4589%])",  # short, tiny, long
        "([4589]) ([4589%]) ([126])",  # long, long, tiny
        "([6-9]) ([1-9])",  # hyphen, anything
        "([12367]) ([4589])",  # short, long
        "([4589]) ([126])",  # long, tiny
    ]
)
_ALL_GROUPS = "".join(f"${group}" for group in range(1, 13))


def _mark(core: Column) -> Column:
    size, word = F.length(core), F.lower(core)
    whole = F.when(word == "or", "@").when(size >= 4, "%").otherwise("0")
    short = F.when(word.isin(*WHOLE_WORDS), whole).otherwise(
        F.when(core.endswith("-"), F.least(size + 4, F.lit(9))).otherwise(size).cast("string")
    )
    # Most tokens are longer than any whole word and settled by their size alone.
    return (
        F.when(size > 5, F.when(core.endswith("-"), "9").otherwise("5"))
        .when(core == "", "_")
        .when(core == "\n", "\n")
        .otherwise(short)
    )


def repair_lines(text: Column) -> Column:
    """Text with split words joined; every line comes out with single blanks between tokens.

    Whether tokens join depends on their sizes and on being whole words. So each token gets a
    one-character mark, one left-to-right regex pass over the marks does the greedy scan by closing gaps,
    and the tokens are put together again with the gaps that are left.
    """
    ended = F.regexp_replace(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, "\n")
    spaced = F.regexp_replace(F.regexp_replace(ended, r"(?U)[^\S\n]+", " "), r"(?dm)^ | $", "")
    # A line end is a token of its own here.
    listed = F.replace(spaced, F.lit("\n"), F.lit(" \n "))

    def join(line: Column) -> Column:
        cores = F.split(F.regexp_replace(line, _AROUND_CORE, ""), " ")
        marks = F.array_join(F.transform(cores, _mark), " ")
        closed = F.regexp_replace(marks, _JOINED, _ALL_GROUPS)
        gaps = F.regexp_replace(F.regexp_replace(closed, r"[^ ](?=[^ ])", "~"), r"[^ ~]", "")
        pieces = F.zip_with(
            F.split(line, " "),
            F.split(gaps, ""),
            lambda token, gap: F.concat(token, F.coalesce(F.when(gap == " ", gap), F.lit(""))),
        )
        return F.replace(F.array_join(pieces, ""), F.lit(" \n "), F.lit("\n"))

    return bind(listed, join)
