"""Exact vector search over DataFrames with an array column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Query vectors are sent to the executors in blocks of at most this many numbers (8 bytes each).
BLOCK_NUMBERS = 4_000_000
MEASURES = ("ip", "cosine", "scaled")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small constant in the denominator, so zero vectors have similarity 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors, size = [], [], 0
    for row in queries.select(id_col, vector_col).filter(F.col(vector_col).isNotNull()).orderBy(id_col).toLocalIterator():
        if ids and size + len(row[1]) > BLOCK_NUMBERS:
            yield ids, np.array(vectors, dtype=np.float64)
            ids, vectors, size = [], [], 0
        ids.append(row[0])
        vectors.append(row[1])
        size += len(row[1])
    if ids:
        yield ids, np.array(vectors, dtype=np.float64)


def top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "vec_id", query_vector: str = "embedding", item_vector: str = "embedding", measure: str = "ip") -> DataFrame:
    """(``query_id``, ``item_id``, ``score``, ``rank``): the ``k`` best items of every query, rank from 0, ties by item id.

    ``measure`` is ``ip`` (inner product), ``cosine`` or ``scaled`` ((1 + cosine)/2, from 0 to 1). A block of query vectors of bounded
    size is sent to all executors; every batch of items is one matrix product there, and a task leaves ``k`` items a query.
    Scores are rounded to 6 decimals. Null vectors never match; an empty side gives no rows.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known are {', '.join(MEASURES)}")
    spark = items.sparkSession
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("score", T.DoubleType())])
    rows = items.select(item_id, item_vector).filter(F.col(item_vector).isNotNull())
    found = None
    for ids, matrix in _query_blocks(queries, query_id, query_vector):
        shared = spark.sparkContext.broadcast((np.array(ids, dtype=object), matrix))
        part = rows.mapInPandas(_best_of(shared, k, query_id, item_id, item_vector, measure), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    ranked = found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k)
    return ranked.select(query_id, item_id, "score", (F.col("__n") - 1).cast("int").alias("rank"))


def _best_of(shared, k: int, query_id: str, item_id: str, item_vector: str, measure: str):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = shared.value
        held, items = np.zeros((len(ids), 0)), None
        for b in batches:
            if not len(b):
                continue
            matrix = np.stack(b[item_vector].to_numpy()).astype(np.float64)
            scores = queries @ matrix.T
            if measure != "ip":
                scores = scores / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :] + 1e-8)
            if measure == "scaled":
                scores = (1.0 + scores) / 2.0
            names = np.broadcast_to(b[item_id].to_numpy(), scores.shape)
            # the best so far stay beside the batch, so a task leaves k items a query however many batches it reads
            held = np.concatenate([held, np.round(scores, 6)], axis=1)
            items = names if items is None else np.concatenate([items, names], axis=1)
            order = np.lexsort((items, -held), axis=1)[:, :k]
            held, items = np.take_along_axis(held, order, axis=1), np.take_along_axis(items, order, axis=1)
        if items is not None:
            yield pd.DataFrame({query_id: np.repeat(ids, held.shape[1]), item_id: items.ravel(), "score": held.ravel()})

    return best


def search_one(items: DataFrame, vector: list[float], k: int, item_id: str = "vec_id", item_vector: str = "embedding") -> DataFrame:
    """The ``k`` best items of one query vector: a projection and a top-k, no Python."""
    query = F.lit([float(x) for x in vector])
    scored = items.filter(F.col(item_vector).isNotNull()).select(item_id, F.round(dot(F.col(item_vector), query), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), item_id).limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), item_id)) - 1).cast("int"))


def find_similar(queries: DataFrame, items: DataFrame, threshold: float = 0.95, k: int = 5, **names: str) -> DataFrame:
    """The ``k`` best first, then those of them that reach the threshold."""
    return top_k(queries, items, k, **names).filter(F.col("score") >= threshold)


def has_similar(queries: DataFrame, items: DataFrame, threshold: float = 0.95, query_id: str = "query_id", **names: str) -> DataFrame:
    """(query, ``has_similar``) for every query."""
    best = top_k(queries, items, 1, query_id=query_id, **names).select(query_id, "score")
    return queries.select(query_id).join(best, query_id, "left").select(query_id, F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("has_similar"))


def mean_vectors(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """The mean of the word vectors of every text, lower case, split at white space; texts without known words get zeros.

    Words meet vectors in an equi-join; sums per dimension are combined within each task.
    """
    tokens = texts.select(id_col, F.explode_outer(F.split(F.lower(F.trim(text_col)), r"\s+")).alias("word"))
    joined = tokens.join(words.select("word", "vector"), "word", "left")
    sums = [F.avg(F.col("vector")[i].cast("double")).alias(f"d{i}") for i in range(dim)]
    return joined.groupBy(id_col).agg(*sums).select(id_col, F.array(*[F.coalesce(f"d{i}", F.lit(0.0)) for i in range(dim)]).alias("vector"))
