import json

from factloom.operators.nested import AGENT_RUN, RUN_COLUMNS, element_places, flatten_records

FACT = {"subject": "a", "predicate": "p", "object": "b", "score": 0.5}
RECORD = {
    "query": "q",
    "tool_calls": [
        {"iteration": 1, "tool": "t", "arguments": {"k": 1}, "result": json.dumps({"facts": [FACT, None, FACT]})},
        None,
        {"iteration": 2, "tool": "u", "result": {"facts": FACT}},
        {"iteration": 3, "tool": "v", "result": None},
    ],
    "validation_history": {"attempt": 1, "proposed": [["a", "p", "b"], "(c, d, e)", None], "validated": {"triplet": ["a", "p", "b"], "status": "validated"}, "rejected": None},
    "validated_triplets": [],
}


def rows(spark, *records):
    return spark.createDataFrame([(k, r, "x", 1) for k, r in records], "run_id long, record string, pos string, child int")


def test_places_of_every_form(spark):
    text = json.dumps(RECORD)
    got = {tuple(r) for r in element_places(rows(spark, (7, text), (7, text), (8, text[:-5]), (9, None), (10, "[]"), (11, ""), (12, "{}")), "record", "run_id", AGENT_RUN).collect()}
    assert got == {
        (7, "tool_calls", 0, -1), (7, "tool_calls", 2, -1), (7, "tool_calls", 3, -1),
        (7, "tool_calls.facts", 0, 0), (7, "tool_calls.facts", 0, 2), (7, "tool_calls.facts", 2, 0),
        (7, "validation_history", 0, -1), (7, "validation_history.proposed", 0, 0), (7, "validation_history.proposed", 0, 1), (7, "validation_history.validated", 0, 0),
    }


def test_flat_tables_keep_parents(spark):
    tables = flatten_records(rows(spark, (7, json.dumps(RECORD)), (7, json.dumps(RECORD)), (8, "{}")), "record", "run_id", AGENT_RUN, RUN_COLUMNS)
    assert sorted(r.run_id for r in tables["runs"].collect()) == [7, 8]
    facts = sorted(tables["tool_calls.facts"].collect())
    assert [(r.pos, r.sub_pos, r.subject, r.score) for r in facts] == [(0, 0, "a", 0.5), (0, 2, "a", 0.5), (2, 0, "a", 0.5)]
    assert [r.triplet for r in sorted(tables["validation_history.proposed"].collect())] == ['["a","p","b"]', "(c, d, e)"]
    assert tables["validated_triplets"].count() == 0


def test_empty_table_and_null_key(spark):
    assert element_places(rows(spark).limit(0), "record", "run_id", AGENT_RUN).count() == 0
    got = flatten_records(rows(spark, (None, '{"query": "a"}'), (None, '{"query": "b"}'), (None, '{"query": "b"}')), "record", "run_id", AGENT_RUN, RUN_COLUMNS)
    assert sorted(r.query for r in got["runs"].collect()) == ["a", "b"]


def test_very_long_record(spark):
    record = json.dumps({"query": "x" * 300_000, "validated_triplets": [{"triplet": ["a", "b", "c"]}] * 2_000})
    assert element_places(rows(spark, (1, record)), "record", "run_id", AGENT_RUN).count() == 2_000
