"""Facts, schemas, questions and training examples from files."""

from __future__ import annotations

import ast
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from factloom.operators.dedup import first_occurrence
from factloom.operators.represent import normalize

FACT_FILE = "canon_kg.txt"
_TRIPLES = T.ArrayType(T.ArrayType(T.StringType()))
#: A list of lists of double-quoted strings without escapes.
_PLAIN_LISTS = r'^\s*\[(\s*\[\s*"[^"\\]*"(\s*,\s*"[^"\\]*")*\s*\]\s*(,(?=\s*\[))?)+\s*\]\s*$'


def fact_file(path: str | Path) -> Path:
    """The file of facts that a path means: the file itself; in a folder that of the highest iteration, else the folder's own."""
    path = Path(path)
    if path.is_file():
        return path
    found = [(int(d.name[4:]), d / FACT_FILE) for d in path.glob("iter*") if d.is_dir() and (d / FACT_FILE).is_file()]
    if found:
        return max(found)[1]
    if (path / FACT_FILE).is_file():
        return path / FACT_FILE
    raise FileNotFoundError(f"no {FACT_FILE} in {path}")


@F.pandas_udf(_TRIPLES)
def _literal_lists(lines: pd.Series) -> pd.Series:
    """Facts of lines in Python notation: lists of exactly three parts; other elements and lines that don't parse are left out."""

    def parse(line):
        if line is None or not line.strip():
            return []
        try:
            value = ast.literal_eval(line.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return []
        if not isinstance(value, list):
            return []
        return [[str(part) for part in item] for item in value if isinstance(item, list) and len(item) == 3]

    return lines.map(parse)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``line_no``, ``value``) of a text file; numbers grow in the order of the file but leave gaps between its splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def parse_fact_lines(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(``line_no``, ``nth``, ``subject``, ``predicate``, ``object``, ``source_text``), a row per fact of a line."""
    # lists of plain double-quoted strings read alike in JSON and in Python; they are parsed in the JVM, only other lines go to Python
    in_json = F.when(F.col(value).rlike(_PLAIN_LISTS), F.from_json(F.col(value), _TRIPLES))
    rest = _literal_lists(F.when(in_json.isNull(), F.col(value)))
    facts = F.coalesce(F.filter(in_json, lambda f: F.size(f) == 3), rest)
    parsed = lines.select(F.col(line_no).alias("line_no"), F.col(value).alias("source_text"), facts.alias("facts"))
    exploded = parsed.select("line_no", "source_text", F.posexplode("facts").alias("nth", "fact"))
    return exploded.select("line_no", "nth", *[F.col("fact")[i].alias(p) for i, p in enumerate(("subject", "predicate", "object"))], "source_text")


def load_facts(spark: SparkSession, path: str | Path, deduplicate: bool = True, normalized: bool = True) -> DataFrame:
    """Parse, then normalise, then keep first occurrences. An empty file raises ValueError."""
    lines = read_lines(spark, str(fact_file(path)))
    if lines.isEmpty():
        raise ValueError(f"{path} holds no lines")
    facts = parse_fact_lines(lines).withColumn("row_id", F.struct("line_no", "nth"))
    if normalized:
        facts = normalize(facts)
    if deduplicate:
        facts = first_occurrence(facts, ["subject", "predicate", "object"], "row_id")
    return facts.drop("row_id")


def read_relation_schema(spark: SparkSession, path: str | Path) -> DataFrame:
    """(``relation``, ``description``) of lines cut at their first comma; lines without one are skipped; no file, no rows."""
    if not Path(path).exists():
        return spark.createDataFrame([], "relation string, description string")
    parts = F.split("value", ",", 2)
    rows = spark.read.text(str(path)).filter(F.contains("value", F.lit(",")) & (F.trim("value") != ""))
    return rows.select(F.trim(parts[0]).alias("relation"), F.trim(parts[1]).alias("description"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("question")).filter("question <> ''")


_CREDITS = "person_name string, movie_title string, release_year int, genre string, role string"


def read_credits(spark: SparkSession, path: str) -> DataFrame:
    """Movie credits from CSV with a header."""
    return spark.read.csv(path, header=True, schema=_CREDITS)


def read_training(spark: SparkSession, path: str | Path | None, own: list[tuple[str, str]] = ()) -> DataFrame:
    """(``question``, ``intent``, ``entities`` map of lists, ``cypher``): a JSON file added to own examples; no file, only those."""
    schema = "question string, intent string, entities map<string, string>, cypher string"
    base = spark.createDataFrame([(q, i, None, None) for q, i in own], schema)
    if path is not None and Path(path).exists():
        base = base.unionByName(spark.read.schema(schema).json(str(path), multiLine=True))
    return base.withColumn("entities", F.transform_values("entities", lambda _, v: as_list(v)))


def as_list(value):
    """A JSON string or list as an array of strings."""
    parsed = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), parsed).otherwise(F.array(value))


def parse_entities(entities):
    """A JSON object whose values are a string or a list, as a map of arrays."""
    return F.transform_values(F.from_json(entities, "map<string, string>"), lambda _, v: as_list(v))


_TRIPLE = re.compile(r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)")


def facts_in_text(text: str | None, underscores: bool = True) -> list[tuple[str, str, str]]:
    """All ``(s, p, o)`` in a text; a comma may occur in the object only. Parts are stripped; blanks become underscores on demand."""
    out = []
    for match in _TRIPLE.finditer(text or ""):
        parts = tuple(p.strip() for p in match.groups())
        if all(parts):
            out.append(tuple(p.replace(" ", "_") for p in parts) if underscores else parts)
    return out


def facts_in_column(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, ``nth``, subject, predicate, object) of all ``(s, p, o)`` in a text column, inside the JVM."""
    pattern = F.lit(r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)")
    groups = [F.regexp_extract_all(text_col, pattern, F.lit(i)) for i in (1, 2, 3)]
    rows = df.select(id_col, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("s", "p", "o"))])).alias("nth", "f"))
    clean = lambda c: F.translate(F.trim(c), " ", "_")
    return rows.select(id_col, "nth", clean(F.col("f")["s"]).alias("subject"), clean(F.col("f")["p"]).alias("predicate"), clean(F.col("f")["o"]).alias("object"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``row_id`` from 1 in a total order, for small tables that have no key; sorts in one partition."""
    return df.withColumn("row_id", F.row_number().over(Window.orderBy(*order)).cast("long"))
