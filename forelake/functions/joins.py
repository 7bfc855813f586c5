"""Joins against tables expected to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forelake.session import stage

BROADCAST_BYTES = 32 << 20


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large table with fitted parameters or choices.

    The small side is written once and measured (runs jobs over it only): bytes of
    its rows written as JSON. Up to ``limit`` bytes it is broadcast, so the large
    side is not shuffled; beyond that both sides are shuffled and adaptive execution
    splits skewed keys.
    """
    staged = stage(small)
    size = staged.agg(F.sum(F.octet_length(F.to_json(F.struct(*staged.columns))))).first()[0]
    fits = (size or 0) <= limit
    return big.join(F.broadcast(staged) if fits else staged, list(on), how)
