"""A store of facts in Parquet: append, upsert, delete, migrate, verify, save and load."""

from __future__ import annotations

import json
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import compare_key
from factloom.operators.dedup import last_write
from factloom.operators.filters import complete
from factloom.session import delete_folder, read_text, write_text

PARTS = ("subject", "predicate", "object")
STORE_COLUMNS = "row_id long, subject string, predicate string, object string, document string, source_text string, representation_mode string, source string, status string, reason string, embedding array<float>"


def upserted(store: DataFrame, *fresh: DataFrame, order: str = "row_id") -> DataFrame:
    """The store after writing each of ``fresh``: keys are the parts as written, the last write wins on all other columns.

    Rows without a complete key are left out. What was written is newer than what was there, whatever its ``order``. However many
    writes there are, they are merged by one aggregation that is combined within each task.
    """
    both = complete(store).withColumn("__batch", F.lit(0))
    for n, rows in enumerate(fresh, 1):
        both = both.unionByName(complete(rows).withColumn("__batch", F.lit(n)), allowMissingColumns=True)
    merged = last_write(both.withColumn("__seq", F.struct("__batch", order)), list(PARTS), "__seq")
    return merged.drop("__batch", "__seq")


class FactStore:
    """Facts in Parquet folders under one path, on any file system Spark can reach; a small JSON file lists the folders that count.

    A write adds the folder of its own rows and nothing else; reading puts the folders together, the last write of a key winning
    where rows were upserted. :meth:`compact` makes one folder of them, as happens by itself after ``MOST_PARTS`` writes. The list
    is replaced after the rows are written, so readers and a lost executor never see half a write.
    """

    MOST_PARTS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")

    @property
    def _manifest(self) -> str:
        return f"{self.path}/current.json"

    def config(self) -> dict:
        text = read_text(self.spark, self._manifest)
        return json.loads(text) if text else {"parts": []}

    def _set(self, config: dict) -> None:
        write_text(self.spark, self._manifest, json.dumps(config))

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """All rows: appended ones as they are, upserted ones merged by key into what was there before."""
        rows = None
        for kind, names in groupby(self.config()["parts"], key=lambda p: p["kind"]):
            parts = [self._part(p["name"]) for p in names]
            if kind == "append":
                for part in parts:
                    rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            else:
                rows = upserted(self.spark.createDataFrame([], STORE_COLUMNS).limit(0) if rows is None else rows, *parts)
        return self.spark.createDataFrame([], STORE_COLUMNS) if rows is None else rows

    def _add(self, df: DataFrame, kind: str) -> None:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        config = self.config()
        self._set(config | {"parts": [*config["parts"], {"kind": kind, "name": name}]})
        if len(config["parts"]) >= self.MOST_PARTS:
            self.compact()

    def append(self, facts: DataFrame) -> None:
        """Add rows as they are, without a look at the keys; only these rows are written."""
        self._add(facts, "append")

    def upsert(self, facts: DataFrame, order: str = "row_id") -> None:
        """Write facts by key; validation columns of the facts stay with them. Only these rows are written."""
        source = F.coalesce("source", F.lit("original")) if "source" in facts.columns else F.lit("original")
        self._add(facts.withColumns({"source": source, "row_id": F.col(order)}), "upsert")

    def compact(self) -> None:
        """Make one folder of all; the folders it replaces are removed, as they are after ``delete_all``."""
        self._replace(self.read())

    def _replace(self, df: DataFrame | None) -> None:
        config = self.config()
        parts = []
        if df is not None and config["parts"]:
            name = f"part-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{name}")
            parts = [{"kind": "append", "name": name}]
        self._set(config | {"parts": parts})
        for part in config["parts"]:
            delete_folder(self.spark, f"{self.path}/{part['name']}")

    def add_vectors(self, facts: DataFrame, vectors: DataFrame, order: str = "row_id") -> None:
        """Append facts with their vectors; both must have the same number of rows."""
        if facts.count() != vectors.count():
            raise ValueError("facts and vectors differ in number")
        self.append(facts.join(vectors, order))

    def delete_all(self) -> None:
        self._replace(None)

    def size(self) -> int:
        return self.read().count()

    def save_config(self, **config) -> None:
        """Settings beside the data, such as the embedding model and the representation mode; never passwords."""
        self._set(self.config() | {k: v for k, v in config.items() if "password" not in k})


def keys_of(store: DataFrame, only_complete: bool = True) -> DataFrame:
    """(subject, predicate, object) of a store; rows with an empty part are left out on demand."""
    rows = store.select(*PARTS)
    return complete(rows) if only_complete else rows


def migrate(source: DataFrame, target: DataFrame, order: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(new target, report with ``migrated`` and ``skipped``): rows with an empty part are skipped, vectors are kept."""
    report = source.agg(
        F.count_if(F.expr(" and ".join(f"coalesce({p}, '') <> ''" for p in PARTS))).alias("migrated"),
        F.count_if(F.expr(" or ".join(f"coalesce({p}, '') = ''" for p in PARTS))).alias("skipped"),
    )
    return upserted(target, source, order=order), report


def verify(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row on a migration: ``source_keys``, ``target_keys``, ``missing`` keys, and ``ratio`` of keys of the source that arrived."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    keys = lambda df: complete(df).select(*[compare_key(F.col(p)).alias(p) for p in PARTS]).distinct()
    row = count(keys(source), "source_keys").crossJoin(count(keys(target), "target_keys")).crossJoin(count(missing_after(source, target), "missing"))
    ratio = F.when(F.col("source_keys") > 0, (F.col("source_keys") - F.col("missing")) / F.col("source_keys")).otherwise(F.lit(1.0))
    return row.withColumn("ratio", ratio)


def missing_after(source: DataFrame, target: DataFrame) -> DataFrame:
    """Keys of the source that the target lacks, normalised."""
    key = [compare_key(F.col(p)).alias(p) for p in PARTS]
    return complete(source).select(*key).distinct().join(complete(target).select(*key).distinct(), list(PARTS), "left_anti")
