"""Facts that differ in formatting only become one (problem 2)."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from factloom.functions.digest import merkle_digest
from factloom.functions.skew import hot_keys
from factloom.functions.text import has_key, value_key

PARTS = ("subject", "predicate", "object")
_FACT = T.StructType([T.StructField(p, T.StringType()) for p in PARTS])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _python_list(payload: pd.Series) -> pd.Series:
    """The three parts of a list in Python notation; null for anything else."""

    def parse(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
        if isinstance(value, dict):
            value = [value.get("subject"), value.get("predicate"), value.get("object", value.get("obj"))]
        if not isinstance(value, (list, tuple)) or len(value) != 3:
            return None
        return [None if x is None else str(x) for x in value]

    return payload.map(parse)


def parse_payloads(df: DataFrame, payload: str, id_col: str) -> DataFrame:
    """(``id``, ``fact`` struct) of every payload that is a JSON object or a list of three in JSON or Python notation.

    JSON is parsed in the JVM; only payloads that are no JSON but begin like a list or object are sent to Python. Payloads that
    do not parse, that are null or empty, or whose list has another length give no row. Further keys are ignored.
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(payload).alias("p"), F.try_parse_json(F.col(payload)).alias("v"))
    other = F.when(v.isNull() & F.col("p").rlike(r"^\s*[\[({]"), F.col("p"))
    rows = rows.select("id", "v", _python_list(other).alias("py"), F.schema_of_variant(v).alias("kind"))
    items = F.try_variant_get(v, "$", "array<string>")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    from_object = F.struct(get("subject").alias("subject"), get("predicate").alias("predicate"), F.coalesce(get("object"), get("obj")).alias("object"))

    def from_list(a: Column) -> Column:
        return F.when(F.size(a) == 3, F.struct(a[0].alias("subject"), a[1].alias("predicate"), a[2].alias("object")))

    fact = F.when(F.col("kind").startswith("OBJECT"), from_object).when(F.col("kind").startswith("ARRAY"), from_list(items)).otherwise(from_list(F.col("py")))
    return rows.select("id", fact.alias("fact")).filter(F.col("fact").isNotNull())


def table_facts(df: DataFrame, id_col: str, subject: str, predicate: str, obj: str) -> DataFrame:
    """(``id``, ``fact`` struct) of a table of facts."""
    return df.select(F.col(id_col).alias("id"), F.struct(F.col(subject).alias("subject"), F.col(predicate).alias("predicate"), F.col(obj).alias("object")).alias("fact"))


def digested(facts: DataFrame) -> DataFrame:
    """(``id``, ``root``, ``leaves``) of the facts that have a key: the root digest and the normalised leaves."""
    for p in PARTS:
        facts = facts.filter(has_key(F.col("fact")[p]))
    leaves = F.struct(*[value_key(F.col("fact")[p]).alias(p) for p in PARTS])
    rows = facts.select("id", leaves.alias("leaves"))
    return rows.select("id", merkle_digest(F.col("leaves"), _FACT).alias("root"), "leaves")


def format_duplicates(facts: DataFrame, hot_floor: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Collapse facts that are the same apart from formatting and the order of fields.

    ``facts`` has ``id`` (unique) and ``fact`` (struct of subject, predicate, object). Returns

    * ``groups``: (``first_id``, ``n_copies``, ``subject``, ``predicate``, ``object``), one row per distinct fact with a key, and
    * ``copies``: (``first_id``, ``copy_id``), one row per further copy.

    Root digests (8 bytes) are counted first; only rows whose digest occurs more than once meet again, and they are confirmed by
    a comparison of all normalised leaves, so a collision of digests never joins different facts. Rows of the largest groups
    (at most 256) are not moved at all: their first ids are combined within each task and broadcast; every other group has
    fewer than 1/256 of all rows. Facts without a key (a
    part null, blank or without letter and digit) are in neither result; ties cannot occur because ids are unique, and a row
    repeated with its id counts twice but gives no pair with itself. Empty input gives empty results.
    """
    rows = digested(facts)
    groups = rows.groupBy("root", "leaves").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).select("first_id", "n_copies", "leaves.*")
    counts = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = F.broadcast(hot_keys(counts, "root", "n", hot_floor))
    hot_rows = rows.join(hot, "root", "left_semi")
    hot_firsts = hot_rows.groupBy("root", "leaves").agg(F.min("id").alias("first_id"))
    hot_pairs = hot_rows.join(F.broadcast(hot_firsts), ["root", "leaves"])
    cold_rows = rows.join(hot, "root", "left_anti").join(counts.select("root"), "root")
    cold_pairs = cold_rows.withColumn("first_id", F.min("id").over(Window.partitionBy("root", "leaves")))
    copies = hot_pairs.select("first_id", "id").unionByName(cold_pairs.select("first_id", "id")).filter("id <> first_id")
    return groups, copies.select("first_id", F.col("id").alias("copy_id"))
