import pytest
from pyspark.sql import functions as F

from factloom.operators import dedup, filters, represent, stats
from factloom.sources import files
from factloom.sources.store import FactStore, migrate, missing_after, upserted

SCHEMA = "row_id long, subject string, predicate string, object string"


def facts(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def test_texts_and_context(spark):
    row = represent.fact_text(facts(spark, ("a_b", "p", None))).first()
    assert (row.text, row.document) == ("a b p ", "(a_b, p, )")
    ctx = represent.entity_context(facts(spark, ("E", "p_1", "x_1"), ("E", "p2", "y"), (None, "p", "o"))).collect()
    assert [(c.text, c.fact_count, c.triplets) for c in ctx] == [("E: p 1: x 1, p2: y", 2, ["(E, p_1, x_1)", "(E, p2, y)"])]


def test_formats(spark):
    rows = facts(spark, ("a_b", "p", "o")).withColumns({"score": F.lit(0.5), "query_id": F.lit("q"), "rank": F.lit(0)})
    assert represent.format_results(rows, "table").first().context.splitlines()[-1] == "| a b | p | o | 0.500 |"
    assert represent.format_results(rows, "scored").first().context == "[0.50] (a b, p, o)"
    assert represent.format_results(rows, "natural").first().context == "a b p o."
    asked = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = {r.query_id: r.context for r in represent.with_empty_context(asked, represent.format_results(rows)).collect()}
    assert got == {"q": "(a b, p, o)", "r": represent.NO_FACTS}


def test_first_occurrence_after_normalising(spark):
    got = dedup.first_occurrence(represent.normalize(facts(spark, ("a_b", "p", "o"), ("a b", "p", "o"))), ["subject", "predicate", "object"], "row_id").collect()
    assert [tuple(r) for r in got] == [(0, "a b", "p", "o")]


def test_statuses_partition_the_batch(spark):
    batch = facts(spark, ("A_b", "p", "o"), ("a b", "p", "o"), ("S", "p", "o"), ("x", "y", "z"), (None, "p", "o"))
    store = facts(spark, ("s ", "P", "o"), ("", "p", "o"))
    similar = spark.createDataFrame([(3, 0.97), (0, 0.2)], "row_id long, similarity double")
    got = {r.row_id: (r.status, r.similarity) for r in dedup.check_duplicates(batch, store, similar=similar).collect()}
    assert got == {0: ("new", None), 1: ("exact", None), 2: ("exact", None), 3: ("semantic", 0.97), 4: ("new", None)}


def test_agent_sets(spark):
    proposals = facts(spark, ("A_b", "p", "o"), ("ab", "P", "o"), ("c", "d", "e"))
    assert [r.row_id for r in dedup.unseen(proposals, facts(spark, ("C", "D", "E"))).collect()] == [0]
    assert dedup.rejected_wins(proposals, facts(spark, ("c", "d", "e"))).count() == 2
    both = dedup.combine_retrieved(proposals.withColumn("score", F.lit(0.9)), proposals)
    assert both.count() == 6 and both.filter("score = 0.5").count() == 3


def test_filters(spark):
    df = facts(spark, ("A", "birthPlace", "b"), ("b", "unknownRel", "a"), ("", "p", "a"))
    schema = spark.createDataFrame([("birthPlace", None), (None, "x")], "relation string, description string")
    assert [r.row_id for r in filters.in_schema(df, schema).collect()] == [0]
    assert filters.in_schema(df, schema.limit(0)).count() == 3
    assert filters.complete(df).count() == 2
    assert [r.row_id for r in filters.entity_lookup(df, "a", limit=2).collect()] == [2, 0]
    assert filters.at_least(df.withColumn("score", F.lit(0.1)), 0.0).count() == 3


def test_relevance(spark):
    asked = spark.createDataFrame([("q", "where born")], "query_id string, query string")
    schema = spark.createDataFrame([("born_in", "place born"), ("other", None)], "relation string, description string")
    assert [tuple(r) for r in stats.relation_relevance(asked, schema).collect()] == [("q", "born_in", 4)]


LINES = ["[['John_Doe','student_at','NUS']]", "[['a','b',None]]", "[('a','b','c'),['p','q'],['x','y','z']]", "garbage", "", "[]", "[['John Doe','student_at','NUS']]"]


def test_fact_files(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"iter{n}").mkdir()
        (tmp_path / f"iter{n}" / files.FACT_FILE).write_text("\n".join(LINES) if n == 10 else "")
    assert files.fact_file(tmp_path).parent.name == "iter10"
    got = sorted((r.subject, r.predicate, r.object) for r in files.load_facts(spark, tmp_path).collect())
    assert got == [("John Doe", "student at", "NUS"), ("a", "b", "None"), ("x", "y", "z")]
    assert files.load_facts(spark, tmp_path, deduplicate=False, normalized=False).count() == 4
    with pytest.raises(ValueError):
        files.load_facts(spark, tmp_path / "iter2")
    with pytest.raises(FileNotFoundError):
        files.fact_file(tmp_path / "none")


def test_schema_questions_training(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b, c\nnocomma\n\nx,\n")
    assert [tuple(r) for r in files.read_relation_schema(spark, tmp_path / "s.csv").collect()] == [("a", "b, c"), ("x", "")]
    assert files.read_relation_schema(spark, tmp_path / "no.csv").count() == 0
    (tmp_path / "q.txt").write_text("one?\n\n two \n")
    assert [r.question for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["one?", "two"]
    (tmp_path / "t.json").write_text('[{"question": "q", "intent": "I", "entities": {"movie": "M", "actors": ["A", "B"]}, "cypher": null}]')
    got = files.read_training(spark, tmp_path / "t.json", [("own", "J")]).collect()
    assert got[0].question == "own" and got[1].entities == {"movie": ["M"], "actors": ["A", "B"]}


def test_facts_in_text(spark):
    text = "(A b, c, d) y (e, f, g, h)"
    assert files.facts_in_text(text) == [("A_b", "c", "d"), ("e", "f", "g,_h")]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    assert [tuple(r)[2:] for r in files.facts_in_column(df, "t", "i").collect()] == files.facts_in_text(text)


def test_upsert_is_idempotent_and_last_wins(spark):
    old = facts(spark, ("a", "p", "b"), ("", "p", "b")).withColumn("source", F.lit("old"))
    new = facts(spark, ("a", "p", "b"), ("a", "p", "b"), ("c", "p", "d")).withColumn("source", F.concat(F.lit("new"), "row_id"))
    once = upserted(old, new)
    assert sorted((r.subject, r.source) for r in once.collect()) == [("a", "new1"), ("c", "new2")]
    assert sorted(map(tuple, upserted(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_store_round_trip(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    assert store.size() == 0
    store.upsert(facts(spark, ("a", "p", "b")))
    store.upsert(facts(spark, ("a", "p", "b"), ("c", "p", "d")))
    assert store.size() == 2 and {r.source for r in store.read().collect()} == {"original"}
    store.add_vectors(facts(spark, ("e", "p", "f")), spark.createDataFrame([(0, [1.0, 0.0])], "row_id long, embedding array<float>"))
    assert store.size() == 3
    with pytest.raises(ValueError):
        store.add_vectors(facts(spark, ("e", "p", "f")), spark.createDataFrame([], "row_id long, embedding array<float>"))
    store.save_config(embedding_model="m", db_password="x")
    assert "db_password" not in FactStore(spark, str(tmp_path / "s")).config()
    target, report = migrate(facts(spark, ("a", "p", "b"), ("", "p", "x")), facts(spark).limit(0))
    assert tuple(report.first()) == (1, 1) and missing_after(facts(spark, ("A ", "p", "b")), target).count() == 0
    store.delete_all()
    assert store.size() == 0


def test_store_writes_only_what_is_new(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "row_id long, subject string, predicate string, object string, status string")
    store.upsert(rows((1, "a", "p", "b", "old"), (2, "c", "p", "d", "old")))
    before = {f for f in (tmp_path / "s").rglob("*.parquet")}
    store.upsert(rows((0, "a", "p", "b", "new")))
    store.append(rows((5, "a", "p", "b", "raw"), (6, None, "p", "b", "raw")))
    added = [f for f in (tmp_path / "s").rglob("*.parquet") if f not in before]
    assert before <= {f for f in (tmp_path / "s").rglob("*.parquet")} and sum(spark.read.parquet(str(f)).count() for f in added) == 3
    expected = [("a", "new"), ("a", "raw"), ("c", "old"), (None, "raw")]
    assert sorted(((r.subject, r.status) for r in store.read().collect()), key=str) == sorted(expected, key=str)
    store.compact()
    assert sorted(((r.subject, r.status) for r in store.read().collect()), key=str) == sorted(expected, key=str)
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    store.delete_all()
    assert store.size() == 0 and not list((tmp_path / "s").glob("part-*"))


def test_parts_of_large_entities(spark):
    rows = [(k, "hot", "p", f"o{k}") for k in range(50)] + [(100, "cold", "is_a", "x_y"), (101, None, "p", "o"), (102, "cold", None, "z")]
    facts = spark.createDataFrame(rows, "row_id long, subject string, predicate string, object string")
    parts = represent.entity_parts(facts, most=10).collect()
    hot = [r for r in parts if r.entity == "hot"]
    assert len(hot) > 1 and sorted(f.order for r in hot for f in r.facts) == list(range(50)) and max(r.fact_count for r in hot) < 25
    assert [(r.part_id, r.text) for r in parts if r.entity == "cold"] == [("cold#0", "cold: is a: x y, : z")]
    assert represent.entity_parts(facts.limit(0)).count() == 0


def test_lines_in_json_and_in_python_read_alike(spark):
    lines = [
        '[["a", "b c", "d"]]', "[['a', 'b c', 'd']]", '[["x","y","z"], ["p","q","r"]]', '[["two", "parts"], ["a", "b", "c"]]', '[["a", "b", "c"],]', '[["a", 1, "c"]]', '[["a\\t", "b", "c"]]', '[["a", "b", "c"]', "", None, "[]", '[["", "b", "é"]] ',
    ]
    got = {}
    for r in files.parse_fact_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).collect():
        got.setdefault(r.line_no, []).append((r.subject, r.predicate, r.object))
    assert got == {
        0: [("a", "b c", "d")], 1: [("a", "b c", "d")], 2: [("x", "y", "z"), ("p", "q", "r")], 3: [("a", "b", "c")], 4: [("a", "b", "c")], 5: [("a", "1", "c")], 6: [("a\t", "b", "c")], 11: [("", "b", "é")],
    }
