"""Queries of the question, translation and retrieval layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.filters import complete
from factloom.plans import cypher, questions, retrieval, views
from factloom.plans.models import HashedEmbedder
from factloom.plans.views import GRAPH_SQL
from factloom.sources.files import parse_entities


def movie_schema(spark: SparkSession, sf_dir: str) -> cypher.Schema:
    """The movie graph as labels and relationship types."""
    g = views.movie_graph(spark, sf_dir)
    return cypher.Schema(
        {"Person": (g.person, "person_id"), "Movie": (g.movie, "movie_id")},
        {"ACTED_IN": (g.acted_in, "Person", "person_id", "Movie", "movie_id"), "DIRECTED": (g.directed, "Person", "person_id", "Movie", "movie_id")},
    )


def _compiled(text: str, **params) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cypher.compile_query(text, movie_schema(spark, sf_dir), **params)


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.augmented(views.table(spark, sf_dir, "training_examples"))


def training_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the training examples, one row per value."""
    rows = views.table(spark, sf_dir, "training_examples").select("question", F.explode(parse_entities(F.col("entities"))).alias("role", "values"))
    return rows.select("question", "role", F.explode("values").alias("value")).distinct()


def intent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = views.table(spark, sf_dir, "training_examples")
    return questions.IntentClassifier.fit(examples).predict(examples.select("question", "intent").filter("question is not null").distinct())


def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents that occur in the credits, case ignored."""
    phrases = views.table(spark, sf_dir, "documents").select("entity").filter("entity is not null").distinct()
    numbered = phrases.select(F.col("entity").alias("question_id"), F.lit(0).alias("nth"), F.col("entity").alias("phrase"))
    names = views.table(spark, sf_dir, "movie_credits").select(F.explode(F.array("movie_title", "person_name")).alias("name")).filter("name is not null").distinct()
    return questions.match_phrases(numbered, names).select(F.col("question_id").alias("phrase"), "name")


def retrieved_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of all training questions over all complete facts, with the stand-in embedder."""
    asked = views.table(spark, sf_dir, "training_examples").select(F.col("question").alias("query_id"), F.col("question").alias("query")).filter("query is not null").distinct()
    embedder = HashedEmbedder(64)
    index = retrieval.build_index(complete(views.facts(spark, sf_dir)), embedder)
    return retrieval.contexts(asked, retrieval.retrieve(asked, index, embedder, 5))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cypher_coactors": _compiled("MATCH (p1:Person {name: $name})-[:ACTED_IN]->(m:Movie)<-[:ACTED_IN]-(p2:Person) RETURN DISTINCT p2.name AS coactor, m.title AS movie", name="Supplier#000000001"),
    "cypher_count": _compiled("MATCH (p:Person)-[r:ACTED_IN|DIRECTED]->(m:Movie) WHERE m.year >= 2020 AND toLower(m.genre) CONTAINS 'standard' RETURN p.name AS person, type(r) AS relationship, count(DISTINCT m) AS movies"),
    "cypher_filter": _compiled("MATCH (m:Movie) WHERE (m.year = 2000 OR m.year IN [2001, 2002]) AND m.genre IS NOT NULL RETURN m.title AS title, m.year AS year ORDER BY m.year DESC, title LIMIT 25"),
    "training_pairs": training_pairs,
    "training_entities": training_entities,
    "intent_predictions": intent_predictions,
    "entity_matches": entity_matches,
    "retrieved_contexts": retrieved_contexts,
}

_PAIRS = "select question, cypher from training_examples where question is not null and cypher is not null"

ORACLES: dict[str, str] = {
    "entity_matches": "with n as (select distinct name from (select movie_title as name from movie_credits union all select person_name from movie_credits) where name is not null), d as (select distinct entity from documents where entity is not null) select entity as phrase, name from d join n on lower(d.entity) = lower(n.name) qualify row_number() over (partition by entity order by (name <> entity)::int, name) = 1",
    "cypher_coactors": f"with {GRAPH_SQL} select distinct p2.name as coactor, title as movie from acted_in a join person p1 on a.person_id = p1.person_id and p1.name = 'Supplier#000000001' join acted_in b on a.movie_id = b.movie_id and a.person_id <> b.person_id join person p2 on b.person_id = p2.person_id join movie on movie.movie_id = a.movie_id",
    "cypher_count": f"with {GRAPH_SQL}, e as (select person_id, movie_id, 'ACTED_IN' as relationship from acted_in union all select person_id, movie_id, 'DIRECTED' from directed) select name as person, relationship, count(distinct movie_id) as movies from e join person using (person_id) join movie using (movie_id) where year >= 2020 and contains(lower(genre), 'standard') group by name, relationship",
    "cypher_filter": f"with {GRAPH_SQL} select title, year from movie where year in (2000, 2001, 2002) and genre is not null order by year desc, title limit 25",
    "training_pairs": f"with p as ({_PAIRS}) select question, cypher from p union all select question, regexp_replace(cypher, 'RETURN .*', 'RETURN *', 's') from p where contains(cypher, 'RETURN') union all select lower(question), cypher from p where contains(cypher, 'RETURN') union all select question || '?', cypher from p where contains(cypher, 'RETURN') and not ends_with(question, '?')",
    "training_entities": "with e as (select question, unnest(json_keys(entities::json)) as role, entities::json as j from training_examples where entities is not null), v as (select question, role, json_extract(j, '$.' || role) as x from e) select distinct question, role, unnest(case when json_type(x) = 'ARRAY' then cast(x as varchar[]) else [x->>'$'] end) as value from v",
}
