"""Bottom-up digests of nested columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from factloom.functions.text import value_key


def merkle_digest(column: Column, dtype: T.DataType, ordered_arrays: bool = True) -> Column:
    """A 64-bit digest of a value of any nested type that ignores formatting and the order of fields.

    Leaves are normalised by :func:`value_key` and hashed; a struct or map is an unordered node, whose children's digests
    (each bound to the name of its field) are sorted before they are hashed; an array is an ordered node unless
    ``ordered_arrays`` is false. A null child and a child without letters or digits count as absent, so an optional field
    may be missing or null. The digest is never null.
    """
    if isinstance(dtype, T.StructType):
        children = []
        for field in dtype.fields:
            child = column.getField(field.name)
            seen = value_key(child) if isinstance(field.dataType, T.StringType) else child
            children.append(F.when(seen.isNotNull(), F.xxhash64(F.lit(field.name.lower()), merkle_digest(child, field.dataType, ordered_arrays))))
        return F.xxhash64(F.lit("node"), F.array_sort(F.array_compact(F.array(*children))))
    if isinstance(dtype, T.ArrayType):
        digests = F.transform(column, lambda x: merkle_digest(x, dtype.elementType, ordered_arrays))
        return F.xxhash64(F.lit("list"), digests if ordered_arrays else F.array_sort(digests))
    if isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(column),
            lambda e: F.xxhash64(F.lower(e.getField("key").cast("string")), merkle_digest(e.getField("value"), dtype.valueType, ordered_arrays)),
        )
        return F.xxhash64(F.lit("node"), F.array_sort(pairs))
    return F.xxhash64(F.coalesce(value_key(column.cast("string")), F.lit("")))
