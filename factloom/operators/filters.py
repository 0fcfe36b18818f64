"""Filters on facts and look-ups of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("subject", "predicate", "object")


def equals_folded(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == F.lower(F.lit(value))


def by_subject(facts: DataFrame, subject: str) -> DataFrame:
    """Facts with this subject, whatever its case."""
    return facts.filter(equals_folded("subject", subject))


def by_relation(facts: DataFrame, predicate: str) -> DataFrame:
    """Facts with this predicate, whatever its case."""
    return facts.filter(equals_folded("predicate", predicate))


def complete(facts: DataFrame) -> DataFrame:
    """Facts whose parts are neither null nor empty."""
    return facts.filter(" and ".join(f"coalesce({p}, '') <> ''" for p in PARTS))


def entity_lookup(facts: DataFrame, entity: str, relation: str | None = None, limit: int = 50) -> DataFrame:
    """Facts with the entity as subject or object, whatever its case, each once, in the order of their parts, the first ``limit``."""
    hit = equals_folded("subject", entity) | equals_folded("object", entity)
    if relation is not None:
        hit = hit & equals_folded("predicate", relation)
    return facts.filter(hit).orderBy(*PARTS).limit(limit)


def relation_key(column: Column) -> Column:
    return F.lower(F.translate(column, " ", "_"))


def in_schema(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """Facts whose predicate is in the relation schema, case and spaces ignored; an empty schema lets all facts pass.

    Whether the schema is small enough to broadcast is left to the planner.
    """
    known = schema.select(relation_key(F.col("relation")).alias("__known")).filter("__known is not null").distinct()
    if known.isEmpty():
        return facts
    return facts.join(known, relation_key(F.col("predicate")) == F.col("__known"), "left_semi")


def at_least(results: DataFrame, min_score: float, score: str = "score") -> DataFrame:
    """Results with this score or more, applied to ranked results; 0 and less let all pass."""
    return results.filter(F.col(score) >= min_score) if min_score > 0 else results


def contains(df: DataFrame, column: str, text: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose column contains a text, without wildcards."""
    c, t = F.col(column), F.lit(text)
    return df.filter(F.contains(F.lower(c), F.lower(t)) if ignore_case else F.contains(c, t))
