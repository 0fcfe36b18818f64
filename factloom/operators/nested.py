"""Deeply nested semi-structured records become related flat tables.

Every target table is one higher-order projection over the parsed record: nested ``transform`` calls attach the keys and places
of all ancestors, ``flatten`` joins the levels, and one ``inline`` emits the rows. Nothing is shuffled but redelivered records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class NestedList:
    """One list to become a table.

    ``path`` leads from the parent's element (the record at the top) to the list; a step that holds JSON text within a string
    counts as what it holds. ``columns`` maps a column to (path in the element, SQL type); the empty path is the element itself.
    """

    name: str
    path: tuple[str, ...]
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    children: tuple["NestedList", ...] = ()


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _unquoted(v: Column) -> Column:
    """What a variant holds, where it is JSON text within a string."""
    text = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(text.isNotNull(), F.try_parse_json(text)).otherwise(v)


def _elements(v: Column) -> Column:
    """The elements of a list; a single object is a list of one; anything else is no list (null)."""
    kind = _kind(v)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(v))


def _list_at(v: Column, path: tuple[str, ...]) -> Column:
    for step in path[:-1]:
        v = _unquoted(F.try_variant_get(v, f"$.{step}", "variant"))
    return _elements(F.try_variant_get(v, f"$.{path[-1]}", "variant"))


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def parse_records(df: DataFrame, record: str, key: str) -> DataFrame:
    """One row (``key``, ``body`` variant) per run of the redelivered, partly broken JSON records of a table.

    Null, empty and cut-off records give no row. Rows with the same key are one record: the first valid one by its text counts,
    so exact redeliveries collapse whatever their number (the digest groups are combined before the shuffle). Rows without a
    key are told apart by their text. Other columns are ignored, so names cannot clash.
    """
    body = F.try_parse_json(F.col(record))
    valid = df.select(F.col(key).alias("__key"), F.col(record).alias("__text"), body.alias("__body")).filter(F.schema_of_variant("__body").startswith("OBJECT"))
    once = valid.groupBy("__key", F.when(F.col("__key").isNull(), F.xxhash64("__text")).alias("__own")).agg(F.min("__text").alias("__text"))
    return once.select(F.col("__key").alias(key), F.parse_json("__text").alias("body"))


def _rows_of(spec: NestedList, body: Column, key: Column, key_name: str) -> Column:
    """Array of structs (key, pos, own columns) of a list at the top."""
    return F.transform(_list_at(body, spec.path), lambda x, i: _row(spec, x, [(key_name, key), ("pos", i.cast("long"))]))


def _row(spec: NestedList, x: Column, keys: list[tuple[str, Column]]) -> Column:
    own = [F.try_variant_get(x, f"$.{path}" if path else "$", kind).alias(name) for name, (path, kind) in spec.columns.items()]
    return F.when(_present(x), F.struct(*[c.alias(n) for n, c in keys], *own))


def flat_table(records: DataFrame, key: str, spec: NestedList, parent: NestedList | None = None) -> DataFrame:
    """The table of one list: the keys of all parents, the place of the element, and the columns of ``spec``.

    ``pos`` is the place in a list at the top; for a list one level down ``pos`` is the parent's place and ``sub_pos`` the
    element's. Places count from 0; null elements give no row but keep their place. An empty or absent list gives no rows.
    """
    body, k = F.col("body"), F.col(key)
    if parent is None:
        rows = _rows_of(spec, body, k, key)
    else:
        rows = F.flatten(
            F.transform(
                F.coalesce(_list_at(body, parent.path), F.array().cast("array<variant>")),
                lambda p, i: F.coalesce(
                    F.transform(
                        _list_at(p, spec.path),
                        lambda x, j: _row(spec, x, [(key, k), ("pos", i.cast("long")), ("sub_pos", j.cast("long"))]),
                    ),
                    F.array(),
                ),
            )
        )
    return records.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def flatten_records(df: DataFrame, record: str, key: str, lists: tuple[NestedList, ...], top: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """All related tables of a nested table: ``runs`` (one row a record, columns ``top``) and one for each list of ``lists``."""
    records = parse_records(df, record, key)
    out = {"runs": records.select(key, *[F.try_variant_get("body", f"$.{p}", t).alias(n) for n, (p, t) in top.items()])}
    for spec in lists:
        out[spec.name] = flat_table(records, key, spec)
        for child in spec.children:
            out[f"{spec.name}.{child.name}"] = flat_table(records, key, child, spec)
    return out


def element_places(df: DataFrame, record: str, key: str, lists: tuple[NestedList, ...]) -> DataFrame:
    """One row (key, child, pos, sub_pos) per element of every list, at the top (sub_pos -1) and one level down.

    Each record is parsed once; the rows of redelivered records collapse after the projection, when they are small.
    """
    body, k = F.col("body"), F.col("__key")

    def place(name: str, x: Column, i: Column, j: Column) -> Column:
        return F.when(_present(x), F.struct(k.alias(key), F.lit(name).alias("child"), i.cast("long").alias("pos"), j.cast("long").alias("sub_pos")))

    def top_places(spec: NestedList) -> Column:
        return F.transform(_list_at(body, spec.path), lambda x, i: place(spec.name, x, i, F.lit(-1)))

    def child_places(spec: NestedList, child: NestedList) -> Column:
        name = f"{spec.name}.{child.name}"
        return F.flatten(
            F.transform(_list_at(body, spec.path), lambda p, i: F.coalesce(F.transform(_list_at(p, child.path), lambda x, j: place(name, x, i, j)), F.array()))
        )

    arrays = [F.coalesce(a, F.array()) for spec in lists for a in (top_places(spec), *(child_places(spec, c) for c in spec.children))]
    parsed = df.select(F.col(key).alias("__key"), F.try_parse_json(F.col(record)).alias("body")).filter(F.col("body").isNotNull())
    rows = parsed.select(F.inline(F.filter(F.flatten(F.array(*arrays)), lambda r: r.isNotNull())))
    return rows.distinct()


_FACT = {"subject": ("subject", "string"), "predicate": ("predicate", "string"), "object": ("object", "string"), "fact": ("fact", "string"), "score": ("score", "double")}
_CHECKED = {"triplet": ("triplet", "string"), "status": ("status", "string"), "reason": ("reason", "string"), "original": ("original", "string")}

#: Columns of a run of a validated agent.
RUN_COLUMNS = {
    "query": ("query", "string"),
    "answer": ("answer", "string"),
    "iterations": ("iterations", "int"),
    "warning": ("warning", "string"),
    "assessment": ("llm_assessment.assessment", "string"),
    "confidence": ("llm_assessment.confidence", "double"),
}

#: The nested lists of a run of a validated agent.
AGENT_RUN = (
    NestedList(
        "tool_calls",
        ("tool_calls",),
        {"iteration": ("iteration", "int"), "tool": ("tool", "string"), "arguments": ("arguments", "string"), "knowledge_iteration": ("knowledge_iteration", "int")},
        (NestedList("facts", ("result", "facts"), _FACT),),
    ),
    NestedList(
        "validation_history",
        ("validation_history",),
        {"attempt": ("attempt", "int"), "all_rejected": ("all_rejected", "boolean"), "remote_model": ("remote_model", "string")},
        (
            NestedList("proposed", ("proposed",), {"triplet": ("", "string")}),
            NestedList("validated", ("validated",), _CHECKED),
            NestedList("rejected", ("rejected",), {"triplet": ("triplet", "string"), "reason": ("reason", "string")}),
        ),
    ),
    NestedList("validated_triplets", ("validated_triplets",), _CHECKED),
)
