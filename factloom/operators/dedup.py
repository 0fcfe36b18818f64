"""Duplicates of facts: ordered, against a store, in agent loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import agent_key, compare_key
from factloom.operators.represent import fact_string

PARTS = ("subject", "predicate", "object")


def first_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key in the order of ``order``; combined within each task before the shuffle.

    ``min_by`` on a struct keeps whole rows, so a key held by many rows is reduced where the rows are.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def last_write(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key in the order of ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def _key() -> list[Column]:
    return [compare_key(F.coalesce(F.col(p), F.lit(""))).alias(f"k_{p}") for p in PARTS]


def store_keys(store: DataFrame) -> DataFrame:
    """Keys of the facts of a store whose parts are all given, as written and normalised (both sides stripped alike)."""
    full = store.filter(" and ".join(f"coalesce({p}, '') <> ''" for p in PARTS))
    return full.select(*PARTS, *_key())


def check_duplicates(candidates: DataFrame, store: DataFrame, order: str = "row_id", similar: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """``candidates`` with ``status`` (``new``, ``exact``, ``semantic``) and ``similarity``.

    In this order: the normalised key came earlier in the batch; the raw or the normalised key is in the store; the best
    similarity in ``similar`` (``order`` column, ``similarity``) reaches the threshold; else new. Raw and normalised keys are looked
    up by two equi-joins, never by one join on a disjunction. ``order`` is unique and not null.
    """
    keys = [f"k_{p}" for p in PARTS]
    rows = candidates.withColumns({k: c for k, c in zip(keys, (compare_key(F.coalesce(F.col(p), F.lit(""))) for p in PARTS))})
    # copies are told from the first of their key by its place, which is found where the rows are; no task holds all copies
    first = rows.groupBy(*keys).agg(F.min(order).alias("__first"))
    rows = rows.join(first, keys)
    held = store_keys(store)
    raw = held.select(*PARTS).distinct().withColumn("__raw", F.lit(True))
    norm = held.select(*keys).distinct().withColumn("__norm", F.lit(True))
    rows = rows.join(raw, list(PARTS), "left").join(norm, keys, "left")
    if similar is None:
        rows = rows.withColumn("similarity", F.lit(None).cast("double"))
    else:
        rows = rows.join(similar.select(order, "similarity"), order, "left")
    exact = (F.col(order) > F.col("__first")) | F.coalesce("__raw", "__norm", F.lit(False))
    close = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    status = F.when(exact, "exact").when(close, "semantic").otherwise("new")
    return rows.select(*candidates.columns, status.alias("status"), F.when(~exact & close, F.col("similarity")).alias("similarity"))


def unseen(proposals: DataFrame, known: DataFrame, order: str = "row_id") -> DataFrame:
    """Proposals of an agent whose key is not known, the first of each key."""
    key = agent_key(fact_string())
    fresh = proposals.withColumn("__key", key).join(known.select(key.alias("__key")).distinct(), "__key", "left_anti")
    return first_occurrence(fresh, ["__key"], order).drop("__key")


def rejected_wins(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted facts that were not rejected too."""
    return accepted.join(rejected.select(*PARTS).distinct(), list(PARTS), "left_anti")


def combine_retrieved(retrieved: DataFrame, expanded: DataFrame, expanded_score: float = 0.5) -> DataFrame:
    """Retrieved and expanded facts together, none dropped; expanded facts have a fixed score and come last."""
    tagged = retrieved.withColumn("origin", F.lit("retrieved"))
    return tagged.unionByName(expanded.withColumns({"score": F.lit(expanded_score), "origin": F.lit("expanded")}), allowMissingColumns=True)


def mentions(*columns: Column) -> Column:
    """The entity mentions of several arrays without repeats."""
    out = columns[0]
    for c in columns[1:]:
        out = F.array_union(out, c)
    return out

