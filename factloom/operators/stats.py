"""Counts, histograms and rankings over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def top_counts(df: DataFrame, column: str, k: int | None = 10, name: str = "n") -> DataFrame:
    """Rows per value, most first, ties by value; the first ``k`` (a top-k plan, no full sort) or all."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counts if k is None else counts.orderBy(F.desc(name), column).limit(k)


def distinct_counts(facts: DataFrame) -> DataFrame:
    """One row: distinct subjects and distinct objects.

    Each is a two-step count (distinct values, then their number), so no task holds a whole set.
    """
    one = lambda c, n: facts.select(c).distinct().agg(F.count(c).alias(n))
    return one("subject", "subjects").crossJoin(one("object", "objects"))


def unique_relations(facts: DataFrame) -> DataFrame:
    return facts.select("predicate").filter("predicate is not null").distinct()


def source_counts(facts: DataFrame) -> DataFrame:
    """Facts per source; a null source is 'original'."""
    return facts.groupBy(F.coalesce("source", F.lit("original")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def label_counts(**tables: DataFrame) -> DataFrame:
    """(``label``, ``n``) of vertex and edge tables."""
    out = None
    for label, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def last_rows(df: DataFrame, order: str, k: int = 10) -> DataFrame:
    """The last ``k`` rows in ascending order."""
    return df.orderBy(F.desc(order)).limit(k).orderBy(order)


def relation_relevance(queries: DataFrame, schema: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(``query_id``, ``relation``, ``score``) of every question and relation.

    10 points if the relation is among the facts' predicates, 3 for each word the question shares with its name and 1 for each it
    shares with its description. Only relations that share a word or are known score, so questions meet relations through their
    words (an equi-join), not through a cross join.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    rel = schema.select("relation", words(F.translate("relation", "_", " ")).alias("name_words"), words(F.col("description")).alias("about_words"))
    named = rel.select("relation", F.explode("name_words").alias("word"), F.lit(3).alias("points"))
    about = rel.select("relation", F.explode("about_words").alias("word"), F.lit(1).alias("points"))
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("word"))
    scored = asked.join(named.unionByName(about), "word").select("query_id", "relation", "points")
    if known is not None:
        lower = known.select("query_id", F.lower(F.translate("predicate", "_", " ")).alias("k")).distinct()
        hit = lower.join(schema.select("relation", F.lower("relation").alias("k")).distinct(), "k").select("query_id", "relation", F.lit(10).alias("points"))
        scored = scored.unionByName(hit)
    return scored.groupBy("query_id", "relation").agg(F.sum("points").alias("score"))
