import random
import unicodedata

from pyspark.sql import functions as F

from factloom.functions.text import value_key
from factloom.llm.format_duplicates import format_duplicates, parse_payloads, table_facts
from factloom.llm.term_frequency import term_frequencies, token_frequencies


def key(v):
    return "".join(c for c in (v or "").lower() if unicodedata.category(c)[0] in "LN") or None


def terms(spark, rows):
    df = spark.createDataFrame(rows, "predicate string, line_no long, term string, record string, occurrences int")
    return {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(df, value_key(F.col("predicate")), F.col("line_no")).collect()}


def test_terms_like_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "A_", "b", "c!", None, "", "  ", "d"] + ["a"] * 6), rng.choice([None, *range(40)]), "x", "y", 1) for _ in range(400)]
    lines = {r[1] for r in rows} - {None}
    want = {}
    for k in {key(r[0]) for r in rows} - {None}:
        mine = [r for r in rows if key(r[0]) == k]
        n = len({r[1] for r in mine} - {None})
        want[k] = (len(mine), n, "rare" if n < 3 else "common" if n > 0.1 * len(lines) else None)
    assert terms(spark, rows) == want


def test_terms_edges(spark):
    assert terms(spark, []) == {}
    assert terms(spark, [(None, 1, "", "", 1)]) == {}
    assert terms(spark, [("a", None, "", "", 1)]) == {"a": (1, 0, "rare")}
    assert terms(spark, [("x" * 200_000, 1, "", "", 1)] * 2) == {"x" * 200_000: (2, 1, "rare")}


def test_marks_at_the_bounds(spark):
    rows = [(f"t{k}", k, "", "", 1) for k in range(40)] + [("edge", k, "", "", 1) for k in range(4)] + [("over", k, "", "", 1) for k in range(5)] + [("low", k, "", "", 1) for k in range(3)]
    got = terms(spark, rows)
    assert (got["edge"][2], got["over"][2], got["low"][2]) == (None, "common", None)


def test_tokens(spark):
    df = spark.createDataFrame([(1, ["a", "a", None]), (2, ["a"]), (3, None)], "id int, words array<string>")
    assert [tuple(r) for r in token_frequencies(df, F.col("words"), F.col("id"), 2).collect()] == [("a", 3, 2, "common")]


PAYLOADS = [
    (10, '{"subject": "New_York", "predicate": "isIn", "object": "USA", "score": 0.5}'), (11, '{"obj": " u.s.a ", "predicate": "IS-IN", "subject": "new york"}'),
    (12, "['New York', 'is_in', 'USA']"), (13, '["New York", "is in", "USA!"]'), (14, '{"subject": "New York", "pred'), (15, None), (16, ""), (17, "['New York', None, 'USA']"),
    (18, '["a", "b"]'), (19, "null"), (20, "{'subject': 'New York', 'predicate': 'is in', 'object': 'usa'}"), (21, '{"subject": "New York", "predicate": "is in", "object": 7}'),
]


def test_payload_forms(spark):
    got = parse_payloads(spark.createDataFrame(PAYLOADS, "id long, payload string"), "payload", "id")
    assert {r.id: tuple(r.fact) for r in got.collect() if r.id in (12, 17, 20, 21)} == {12: ("New York", "is_in", "USA"), 17: ("New York", None, "USA"), 20: ("New York", "is in", "usa"), 21: ("New York", "is in", "7")}
    groups, copies = format_duplicates(got)
    assert sorted(map(tuple, copies.collect())) == [(10, 11), (10, 12), (10, 13), (10, 20)]
    assert {r.first_id: r.n_copies for r in groups.collect()} == {10: 5, 21: 1}


def brute(rows):
    groups = {}
    for i, s, p, o in rows:
        k = (key(s), key(p), key(o))
        if all(k):
            groups.setdefault(k, []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def facts(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, s string, p string, o string, root string")
    return table_facts(df, "id", "s", "p", "o")


def test_copies_like_brute_force_hot_and_cold(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["A b", "a_B", "AB.", "c", "C!", None, "", "-", "d", "É", "é"])
    rows = [(k, "hot", "h", "x") for k in range(100)] + [(100 + k, part(), part(), part()) for k in range(500)]
    rng.shuffle(rows)
    for floor in (2, 50, 10_000):
        assert sorted(map(tuple, format_duplicates(facts(spark, rows), hot_floor=floor)[1].collect())) == brute(rows)


def test_swapped_parts_are_other_facts(spark):
    rows = [(1, "a", "p", "b"), (2, "b", "p", "a"), (3, "ab", "p", "c"), (4, "a", "bp", "c")]
    assert format_duplicates(facts(spark, rows))[1].count() == 0


def test_format_edges(spark):
    groups, copies = format_duplicates(facts(spark, []))
    assert groups.count() == copies.count() == 0
    long = [(1, "x y" * 50_000, "p", "o"), (2, "X_Y" * 50_000, "p", "o"), (2, "X_Y" * 50_000, "p", "o")]
    assert set(map(tuple, format_duplicates(facts(spark, long))[1].collect())) == {(1, 2)}
