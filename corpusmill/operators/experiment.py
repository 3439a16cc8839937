"""Grids of configurations over a table of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def experiment_grid(questions: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every question once per combination of the given choices.

    The choices are configuration lists, so each is unfolded inside the row.
    """
    grid = questions
    for name, choices in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(choice) for choice in choices])))
    return grid
