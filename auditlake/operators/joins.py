"""Joins of a large table to a side whose size or key skew is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.durable import durable

BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to send to every executor. Runs a job that sums its size."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("size")).first()["size"]
    return (size or 0) <= limit


def join_bounded(large: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that keeps the large side where it is if the small side, measured, fits in memory.

    For large sides that carry file contents or log lines: a planner estimate would shuffle them,
    since it cannot know that a filter or aggregate left little. The small side is written once, so
    that measuring it does not compute it twice. Beyond the limit both sides are shuffled.
    """
    small = durable(small)
    if fits(small, limit):
        return large.join(F.broadcast(small), on, how)
    return skewed_join(large, small, on, how)


def skewed_join(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join in which one key may hold a large share of the large side's rows.

    As a sort-merge join, adaptive execution measures the shuffled partitions and divides those that
    are far larger than the others into as many tasks as their size asks for. Only the left side of
    these join types can be divided; a right or full join is not offered.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} would not divide the large side")
    return large.join(small, on, how)
