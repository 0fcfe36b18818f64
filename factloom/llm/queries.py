"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import value_key
from factloom.llm.abuse import flagged, score_documents, source_rates
from factloom.llm.contamination import find_leaks
from factloom.llm.entity_linking import link_entities, linked_pairs
from factloom.llm.fact_history import judge_batches
from factloom.llm.format_duplicates import format_duplicates, parse_payloads, table_facts
from factloom.llm.mixing import count_tokens, length_weight, mix_sources
from factloom.llm.term_frequency import term_frequencies


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_predicate_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct predicate (by its key) with its rows, lines and mark."""
    return term_frequencies(_read(spark, sf_dir, "triplets"), value_key(F.col("predicate")), F.col("line_no"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_predicate_frequencies(spark, sf_dir).filter(F.col("mark").isNotNull()).select(F.col("term").alias("predicate_key"), "mark")


def _all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table_facts(_read(spark, sf_dir, "triplets"), "triplet_id", "subject", "predicate", "obj")
    return accepted.unionByName(parse_payloads(_read(spark, sf_dir, "raw_triplets"), "payload", "triplet_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates(_all_facts(spark, sf_dir))[1]


def p2_distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct fact with the number of its copies."""
    return format_duplicates(_all_facts(spark, sf_dir))[0]


def p4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposal with a key: new, exact or near."""
    return judge_batches(_read(spark, sf_dir, "triplets"), _read(spark, sf_dir, "proposals"), _read(spark, sf_dir, "relation_schema"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_verdicts(spark, sf_dir).filter("verdict <> 'new'")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the cluster of its entity."""
    return link_entities(_read(spark, sf_dir, "entities"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(p5_clusters(spark, sf_dir))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every item that leaked into it, and how."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold 12 words in a row."""
    return p6_leaks(spark, sf_dir).filter("kind = 'verbatim'").select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: in how many documents it leaked, verbatim and edited."""
    leaks = p6_leaks(spark, sf_dir)
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("kind") == "verbatim").alias("verbatim"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(_read(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix_sources(sized.withColumn("weight", length_weight(F.col("tokens"))), _read(spark, sf_dir, "source_targets"), weight_col="weight")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their copies."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: wanted and reached tokens and shares."""
    return _mix(spark, sf_dir)[1]


def p8_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores."""
    return score_documents(_read(spark, sf_dir, "documents"), extra=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(score_documents(_read(spark, sf_dir, "documents")))


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of abusive, hateful and sexual documents of every source."""
    return source_rates(p8_document_scores(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_predicate_frequencies": p1_predicate_frequencies,
    "p2_found": p2_found,
    "p2_distinct_facts": p2_distinct_facts,
    "p4_found": p4_found,
    "p4_verdicts": p4_verdicts,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_verbatim": p6_verbatim,
    "p6_leaked_items": p6_leaked_items,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_document_scores": p8_document_scores,
    "p8_source_rates": p8_source_rates,
}
