"""Frequency of every distinct value or term, and marks for the useless ones (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def term_frequencies(df: DataFrame, term: Column, record: Column, min_records: int = 3, max_share: float = 0.10) -> DataFrame:
    """One row (``term``, ``occurrences``, ``records``, ``mark``) per distinct term.

    Counts are first made per (record, term), partially combined by hash within each task before any shuffle, then summed per
    term the same way: what is shuffled in the second step is one row per task and term, so a term held by a third of all rows
    costs no more than any other. ``mark`` is ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of all
    distinct records of ``df`` (those without a term included) and null otherwise; ``rare`` wins where both hold.

    Rows with a null term are not counted. A null record counts as an occurrence, not as a record. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    pairs = df.select(term.alias("term"), record.alias("record"))
    per_record = pairs.filter(F.col("term").isNotNull()).groupBy("record", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = per_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    return marked(totals, record_total(df, record), min_records, max_share)


def token_frequencies(df: DataFrame, tokens: Column, record: Column, min_records: int = 3, max_share: float = 0.10) -> DataFrame:
    """As :func:`term_frequencies`, for records that hold an array of terms each; null arrays and null terms count as empty."""
    exploded = df.select(record.alias("record"), F.explode(tokens).alias("term"))
    per_record = exploded.filter(F.col("term").isNotNull()).groupBy("record", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = per_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    return marked(totals, record_total(df, record), min_records, max_share)


def record_total(df: DataFrame, record: Column) -> DataFrame:
    """One row: the number of distinct non-null records. Only the record column is read."""
    return df.select(record.alias("record")).distinct().agg(F.count("record").alias("all_records"))


def marked(totals: DataFrame, total: DataFrame, min_records: int, max_share: float) -> DataFrame:
    """Apply the frequency bounds; ``total`` is one row, so joining it is a broadcast of one number."""
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.col("all_records") * F.lit(max_share), "common")
    return totals.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
