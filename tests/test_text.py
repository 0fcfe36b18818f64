import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.digest import merkle_digest

VALUES = ["New_York", " a b ", "«Ärger»", "!!!", "", None, "İx", "𝔘ni", "x²", "​z"]


def key(v):
    k = "".join(c for c in (v or "").lower() if unicodedata.category(c)[0] in "LN")
    return k or None


def test_value_key(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", text.value_key(F.col("v")).alias("k"), text.has_key(F.col("v")).alias("h"))
    for r in df.collect():
        assert r.k == key(r.v)
        assert r.h == (r.k is not None)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_value_key_like_python(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v string").select(text.value_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in got] == [key(v) for v in values]


def test_compare_and_agent_keys(spark):
    df = spark.createDataFrame([("\tA_b \n", "(A_b, p, o)")], "v string, f string")
    assert tuple(df.select(text.compare_key(F.col("v")), text.agent_key(F.col("f"))).first()) == ("a b", "ab|p|o")


def test_small_functions(spark):
    df = spark.createDataFrame([('in 1999 and 2042, "two words"', "hELLO wORLD", "abcdefghijklmnopqr")], "q string, c string, l string")
    row = df.select(text.years_in(F.col("q")), text.quoted_in(F.col("q")), text.capitalize_first(F.col("c")), text.truncated(F.col("l"), 15), text.clamp(F.lit(50), 1, 20), text.unit_interval(F.lit(7.0))).first()
    assert list(row) == [[1999, 2042], ["two words"], "Hello world", "abcdefghijklmno...", 20, 1.0]


def test_digest_ignores_formatting_and_order(spark):
    df = spark.createDataFrame([({"a": "New_York", "b": "x"}, [{"k": "A b"}, {"k": "c"}]), ({"b": " X.", "a": "new york"}, [{"k": "a_B"}, {"k": "C!"}]), ({"a": "x", "b": "New York"}, [{"k": "c"}, {"k": "ab"}])], "m map<string,string>, l array<struct<k:string>>")
    got = [r.d for r in df.select(merkle_digest(F.struct("m", "l"), df.schema).alias("d")).collect()]
    assert got[0] == got[1] != got[2]
    loose = [r.d for r in df.select(merkle_digest(F.col("l"), df.schema["l"].dataType, ordered_arrays=False).alias("d")).collect()]
    assert loose[0] == loose[2]


def test_unknown_mode():
    from factloom.operators.represent import represent

    with pytest.raises(ValueError, match="triplet_text"):
        represent(None, "other")
