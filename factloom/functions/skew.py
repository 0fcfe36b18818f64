"""Joins that survive a key held by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are treated as hot, so what is broadcast is bounded whatever the data.
HOT_KEYS = 256


def hot_keys(counts: DataFrame, key: str, size: str, floor: int = 10_000, most: int = HOT_KEYS) -> DataFrame:
    """The keys with the largest groups, at most ``most`` of them and none smaller than ``floor`` rows.

    Every other key then holds fewer rows than 1/``most`` of all, so one task can hold its group's rows in a stream.
    """
    return counts.filter(F.col(size) >= floor).orderBy(F.desc(size), key).limit(most).select(key)

