import json

import pytest

from factloom.operators import movies
from factloom.operators.movies import MovieGraph
from factloom.plans import cli, cypher, questions, rendering, retrieval
from factloom.plans.agent import ToolAgent, ValidatingAgent, tool_call_in
from factloom.plans.models import HashedEmbedder, ScriptedChat, embed_column
from factloom.plans.tools import Toolbox
from factloom.plans.validation import read_assessment, read_justification, read_reproposal, read_validation, validate
from factloom.sources.store import FactStore

ABC = ["a", "b", "c"]


def test_validation_replies():
    both = json.dumps({"validated": [{"triplet": ABC}, {"triplet": ["x y", "p", "z"]}], "rejected": [{"triplet": ABC, "reason": "no"}], "corrected": [{"original": ABC, "corrected": ["a", "b", "d"]}]})
    got = read_validation(f"text ```json\n{both}\n``` more")
    assert [(c.fact, c.status) for c in got.accepted] == [(("x_y", "p", "z"), "validated"), (("a", "b", "d"), "corrected")]
    assert [c.fact for c in got.rejected] == [("a", "b", "c")] and not got.all_rejected
    assert "[corrected] (a, b, d) (from (a, b, c))" in got.notice()
    assert not read_validation("no json").accepted and not read_validation("no json").rejected
    assert read_validation('{"validated": [{"triplet": "(a, b, c)"}]}').accepted == []

    class Broken:
        name = "m"

        def reply(self, *a, **k):
            raise RuntimeError("down")

    failed = validate([("a", "b", "c")], "q", Broken())
    assert failed.model == "error" and failed.all_rejected


def test_other_replies():
    got = read_assessment('{"assessment": "maybe", "confidence": 7, "proposed_triplets": [["a","b","c","d"], ["x"]]}')
    assert (got.label, got.confidence, got.proposed) == ("INSUFFICIENT", 1.0, [("a", "b", "c")])
    assert read_assessment(None).confidence == 0.0
    assert read_reproposal("no", [("p", "q", "r")]) == [("p", "q", "r")]
    facts = [("a", "b", "c"), ("d", "e", "f")]
    assert read_justification('{"persist": [], "skip": []}', facts) == facts
    assert read_justification('{"persist": [{"triplet": ["a","b","c"]}], "skip": []}', facts) == facts[:1]
    assert tool_call_in('```json\n{"tool": "t", "arguments": {"a": 1}}\n```') == ("t", {"a": 1}) and tool_call_in("plain") is None


def test_split_fact():
    assert retrieval.split_fact("(a, b, c)") == ("a", "b", "c") and retrieval.split_fact("(a, b, c, d)") is None


def graph(spark):
    person = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo"), (3, "Cy")], "person_id int, name string")
    movie = spark.createDataFrame([(1, "Rain", 2000, "Drama"), (2, "Snow", 2010, None)], "movie_id int, title string, year int, genre string")
    acted = spark.createDataFrame([(1, 1, "lead"), (2, 1, "extra"), (2, 2, "lead"), (3, 2, None)], "person_id int, movie_id int, role string")
    return MovieGraph(person, movie, acted, spark.createDataFrame([(3, 1)], "person_id int, movie_id int"))


def schema(spark):
    g = graph(spark)
    return cypher.Schema({"Person": (g.person, "person_id"), "Movie": (g.movie, "movie_id")}, {"ACTED_IN": (g.acted_in, "Person", "person_id", "Movie", "movie_id"), "DIRECTED": (g.directed, "Person", "person_id", "Movie", "movie_id")})


def test_cypher(spark):
    s = schema(spark)
    run = lambda q, **p: [tuple(r) for r in cypher.compile_query(q, s, **p).collect()]
    assert run("MATCH (a:Person {name: 'Ann Lee'})-[:ACTED_IN]->(m)<-[:ACTED_IN]-(b:Person) RETURN DISTINCT b.name AS n, m.title") == [("Bo", "Rain")]
    assert sorted(run("MATCH (p:Person)-[r:ACTED_IN|DIRECTED]->(m:Movie) WHERE m.title = $t RETURN p.name AS n, type(r) AS t", t="Rain")) == [("Ann Lee", "ACTED_IN"), ("Bo", "ACTED_IN"), ("Cy", "DIRECTED")]
    assert run("MATCH (m:Movie) WHERE m.year = 1 RETURN count(m) AS n") == [(0,)]

    assert run("MATCH (m:Movie) RETURN m.title AS title, m.genre AS genre ORDER BY genre LIMIT 2") == [("Rain", "Drama"), ("Snow", None)]
    assert run("MATCH (m:Movie) WHERE NOT (m.genre IS NULL) AND toLower(m.title) CONTAINS 'rai' RETURN m.title") == [("Rain",)]
    path = cypher.compile_query("MATCH p = shortestPath((a:Person {name: 'Ann Lee'})-[*]-(b:Person {name: 'Cy'})) RETURN p", s).first()
    assert path.length == 2
    for bad in ("MATCH (t) DELETE t", "MATCH (t:Movie) DELETE t RETURN 1", "RETURN 1", "MATCH (m:Movie)", "MATCH (m:Nope) RETURN m.x", "MATCH (m:Movie) RETURN z.x", "MATCH (m:Movie) RETURN m.title ¤"):
        with pytest.raises(Exception):
            cypher.compile_query(bad, s).columns
    assert run("MATCH (m:Movie {title: 'x DELETE'}) RETURN m.title") == []


def test_questions(spark):
    found = questions.find_mentions('Sci-Fi or science fiction from 1999 "a b"?')
    assert (found.years, found.genres) == ([1999], ["Sci-Fi", "Sci-Fi"]) and found.phrases[0] == "a b"
    assert questions.match_entity("Hanks", ["Tom Hanks"]) == questions.match_entity("to", ["Tom Hanks"]) == "Tom Hanks"
    assert questions.match_entity("x", ["ab"]) is None
    assert questions.bind(("actor", "actor2"), {"actors": ["A"]}) is None
    examples = spark.createDataFrame([("Tom Hanks movies", "MATCH (m) RETURN m.title"), ("q?", None)], "question string, cypher string")
    assert sorted(tuple(r) for r in questions.augmented(examples).collect()) == sorted([("Tom Hanks movies", "MATCH (m) RETURN m.title"), ("Tom Hanks movies", "MATCH (m) RETURN *"), ("tom hanks movies", "MATCH (m) RETURN m.title"), ("Tom Hanks movies?", "MATCH (m) RETURN m.title")])


def test_question_pipeline(spark, tmp_path):
    rows = [(f"who acted in {m}", "find_actors") for m in ("Rain", "Snow", "X", "Y")] + [(f"how many movies has {p}", "count_movies") for p in ("Bo", "Ann Lee", "Cy", "Z")] + [(None, "x"), ("y", None)]
    model = questions.IntentClassifier.fit(spark.createDataFrame(rows, "question string, intent string"))
    model.save(str(tmp_path / "m"))
    pipe = questions.QuestionPipeline(graph(spark), questions.IntentClassifier.load(str(tmp_path / "m")))
    out, got = pipe.ask("who acted in rain")
    assert out.success and sorted(r["actor"] for r in got) == ["Ann Lee", "Bo"]
    out, got = pipe.ask("how many movies has Bo")
    assert out.success and got == [{"movie_count": 2}]
    assert not pipe.convert("who acted in").success


def test_ways_to_answer():
    named = {"actors": ["A", "B"], "movies": [], "years": [1999], "genres": []}
    way, values = questions.choose("find_movies_by_actor", named)
    assert values == ["A"] and way.needs == ("actor",)
    assert questions.choose("find_actors", named) is None and questions.choose("nothing", named) is None
    assert questions.choose("count_movies", {})[1] == [] and questions.choose("find_movies_by_genre", {})[0].needs == ()
    assert questions.choose("find_movies_by_year", named, since=True)[0] is not questions.choose("find_movies_by_year", named)[0]
    assert questions.find_mentions("a documentary, crime or Comedy").genres == ["Comedy", "Documentary"]


def test_cascade_of_names(spark):
    names = spark.createDataFrame([("Tom Hanks",), ("Ann",)], "name string")
    phrases = spark.createDataFrame([(0, 0, "hanks"), (0, 1, "to"), (0, 2, "see Tom Hanks now"), (0, 3, "annexed"), (0, 4, None)], "question_id int, nth int, phrase string")
    assert {(r.nth, r.name) for r in questions.contained_phrases(phrases, names).collect()} == {(0, "Tom Hanks"), (2, "Tom Hanks")}
    model = questions.IntentClassifier.fit(spark.createDataFrame([(f"since when {k}", "find_movies_by_year") for k in range(4)] + [(f"who {k}", "find_actors") for k in range(4)], "question string, intent string"))
    g = graph(spark)
    pipe = questions.QuestionPipeline(g, model, HashedEmbedder(64))
    assert pipe.entities("films of ann lee")["actors"] == ["Ann Lee"]
    assert pipe.entities("who is Ann Le")["actors"][0] == "Ann Lee"


def test_genre_vertices(spark):
    g = graph(spark)
    assert {r.name for r in movies.genres(g).collect()} == {r.genre_id for r in movies.in_genre(g).collect()} == {"Drama"}
    assert [r.movie for r in movies.movies_of_genre(g, "Drama").collect()] == ["Rain"]
    assert movies.movies_of(g, "Ann", exact=False).count() == movies.movies_of(g, "Ann Lee").count() > 0 == movies.movies_of(g, "Ann").count()


def test_rendering(spark):
    text = rendering.result_table(spark.range(25).withColumnRenamed("id", "n").selectExpr("n", "n as m"))
    assert text.splitlines()[-1] == "... and 5 more results" and len(text.splitlines()) == 23
    assert rendering.result_table(spark.range(1)) == "0" and rendering.result_table(spark.range(0)) == "No results"


def store(spark, tmp_path):
    s = FactStore(spark, str(tmp_path / "facts"))
    s.upsert(spark.createDataFrame([(0, "Ann", "lives_in", "Rome"), (1, "Bo", "lives_in", "Oslo"), (2, "Rome", "part_of", "Italy")], "row_id long, subject string, predicate string, object string"))
    return s


def test_embedder(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    got = [r.embedding for r in embed_column(df, HashedEmbedder(16)).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-5) and got[1] is None


def test_tools(spark, tmp_path):
    box = Toolbox(spark, store(spark, tmp_path), HashedEmbedder(64), ScriptedChat("(Ann, knows, Bo)"))
    call = lambda n, **a: json.loads(box.call(n, a))
    assert call("query_entity", entity="rome")["num_results"] == 2
    assert call("expand_entity", entity="Ann", depth=99)["num_results"] == 2
    assert call("search_knowledge_graph", query="Ann lives in Rome", top_k=0)["facts"][0]["subject"] == "Ann"
    assert "error" in call("run_cypher", query="MATCH (t) DELETE t") and "error" in call("nothing")
    assert call("run_cypher", query="MATCH (t:Triplet) WHERE t.object = 'Rome' RETURN t.subject AS s")["results"] == [{"s": "Ann"}]
    assert call("expand_triplets", query="q", facts="(Ann, lives in, Rome)", persist=True)["persisted_count"] == 1
    assert call("validate_and_persist_triplets", query="q", triplets="(X, y, z)", skip_validation=True)["persisted_count"] == 1
    assert {r.status for r in box.store.read().filter("subject = 'X'").collect()} == {"validated"}
    assert len(Toolbox(spark, box.store, HashedEmbedder(8), allow_cypher=False).tools()) == 3


def test_agents(spark, tmp_path):
    box = Toolbox(spark, store(spark, tmp_path), HashedEmbedder(64))
    run = ToolAgent(box, ScriptedChat('{"tool": "query_entity", "arguments": {"entity": "Ann"}}', "Answer: Rome")).run("where?")
    assert run.answer == "Rome" and run.tool_calls[0]["result"]["num_results"] == 1
    model = ScriptedChat(
        '{"assessment": "INSUFFICIENT", "proposed_triplets": [["Cy", "lives_in", "Bonn"], ["Ann", "lives in", "Rome"]]}', '{"proposed_triplets": [["Cy", "lives_in", "Ulm"]]}',
        '{"assessment": "SUFFICIENT", "confidence": 0.9}', "Cy lives in Ulm.", "no json",
    )
    checker = ScriptedChat('{"rejected": [{"triplet": ["Cy", "lives_in", "Bonn"], "reason": "no"}]}', '{"validated": [{"triplet": ["Cy", "lives_in", "Ulm"]}]}', name="checker")
    run = ValidatingAgent(box, model, checker).run("where does Cy live?")
    assert run.answer == "Cy lives in Ulm." and run.persisted == 1 and len(run.validation_history) == 2
    assert box.store.read().filter("object = 'Ulm'").count() == 1


def test_generator(spark, tmp_path):
    index = retrieval.build_index(store(spark, tmp_path).read(), HashedEmbedder(64))
    out = retrieval.Generator(index, HashedEmbedder(64), ScriptedChat("(Ann, knows, Bo_B)", "fine"), persist=len).answer("Ann?", k=2, expand=True)
    assert out.answer == "fine" and out.expanded == [("Ann", "knows", "Bo_B")] and out.persisted == 1 and len(out.scores) == 3
    with pytest.raises(ValueError):
        retrieval.build_index(index.limit(0), HashedEmbedder(8))


def test_new_facts_are_stored_once(spark, tmp_path):
    box = store(spark, tmp_path)
    rows = spark.createDataFrame([(10, "Ann", "lives in", "Rome"), (11, "Cy", "lives_in", "Ulm"), (12, "cy", "lives in", "ulm"), (13, "Bo", "lives-in", "Oslo")], "row_id long, subject string, predicate string, object string")
    assert retrieval.add_new_facts(box, rows, HashedEmbedder(256), threshold=0.6) == 1
    assert box.size() == 4 and retrieval.add_new_facts(box, rows, HashedEmbedder(256), threshold=0.6) == 0


def test_entities_are_retrieved_with_all_facts(spark):
    facts = spark.createDataFrame([(0, "Ann", "lives_in", "Rome, Italy"), (1, "Ann", "knows", "Bo"), (2, "Zed", "is", "far")], "row_id long, subject string, predicate string, object string")
    index = retrieval.build_entity_index(facts, HashedEmbedder(64))
    asked = spark.createDataFrame([("q", "Ann: lives in: Rome")], "query_id string, query string")
    got = retrieval.retrieve_entities(asked, index, HashedEmbedder(64), 1).orderBy("nth").collect()
    assert [(r.subject, r.predicate, r.object) for r in got] == [("Ann", "lives_in", "Rome, Italy"), ("Ann", "knows", "Bo")] and len({r.score for r in got}) == 1


def test_translator_and_split(spark):
    from factloom.plans.models import TableTranslator

    assert TableTranslator({"Who?": "MATCH"}).translate("translate to a graph query: who") == "MATCH"
    df = spark.createDataFrame([(f"q{k}",) for k in range(500)] * 2, "question string")
    train, held = questions.split_examples(df)
    assert train.count() + held.count() == 1000 and 50 < held.count() < 160 and train.join(held, "question").count() == 0


def scripted():
    return ScriptedChat("Answer: Rome")


def test_command_line_and_chat(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("[['Ann', 'lives_in', 'Rome']]\n[['Bo', 'lives_in', 'Oslo']]\n")
    path = str(tmp_path / "s")
    assert cli.main(["index", path, str(tmp_path / "in.txt")]) == 0
    assert FactStore(spark, path).read().filter("embedding is null").count() == 0
    assert cli.main(["answer", path, "where is Ann?", "where is Bo?", "--model", "tests.test_plans:scripted", "--save", str(tmp_path / "out")]) == 0
    assert cli.main(["entity", path, "ann"]) == 0
    out = capsys.readouterr().out
    assert "2 facts" in out and out.count("Rome") >= 2 and '"answers": 2' in out and spark.read.json(str(tmp_path / "out")).count() == 2
    said = []
    runs = cli.chat(Toolbox(spark, FactStore(spark, path), HashedEmbedder(64)), scripted(), ["/help", "where is Ann?", "/history", "/nope", "/stats", "", "/quit", "never"], said.append)
    assert [r.query for r in runs] == ["where is Ann?"] and said[1] == "Rome" and "/tools" in said[0] and "unknown" in said[3] and said[4] == "2 facts, 1 questions"
