"""Queries of the core operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.functions.text import agent_key, compare_key, quoted_in, truncated, years_in
from factloom.operators import dedup, filters, graph, movies, represent, stats, vector
from factloom.plans import views
from factloom.plans.views import FACTS_SQL, GRAPH_SQL, PROPOSED_SQL, TRADE_SQL
from factloom.session import spool
from factloom.sources import files, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


ENTITY = "Republic_of_Kamabafstom"
SUPPLIER = "Supplier#000000001"
_HUMAN = lambda c: f"replace(coalesce({c}, ''), '_', ' ')"
_DOC = "concat('(', coalesce(subject, ''), ', ', coalesce(predicate, ''), ', ', coalesce(object, ''), ')')"
_STRIP = lambda c: f"regexp_replace(lower(replace({c}, '_', ' ')), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
_FULL = "coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(object, '') <> ''"

# --- representations ---------------------------------------------------------------------------------------------------------


@_query(f"with {FACTS_SQL} select row_id, {_HUMAN('subject')} || ' ' || {_HUMAN('predicate')} || ' ' || {_HUMAN('object')} as text, {_DOC} as document from facts")
def triple_text(spark, sf_dir):
    return represent.fact_text(views.facts(spark, sf_dir)).select("row_id", "text", "document")


@_query(
    f"with {FACTS_SQL} select subject as entity, replace(subject, '_', ' ') || ': ' || string_agg({_HUMAN('predicate')} || ': ' || {_HUMAN('object')}, ', ' order by row_id) as text, count(*)::int as fact_count "
    "from facts where subject is not null group by subject"
)
def entity_context(spark, sf_dir):
    return represent.entity_context(views.facts(spark, sf_dir)).select("entity", "text", "fact_count")


@_query(f"with {FACTS_SQL} select row_id, '(' || {_HUMAN('subject')} || ', ' || {_HUMAN('predicate')} || ', ' || {_HUMAN('object')} || ')' as listed, {_HUMAN('subject')} || ' ' || {_HUMAN('predicate')} || ' ' || {_HUMAN('object')} || '.' as sentence from facts")
def fact_lines(spark, sf_dir):
    return views.facts(spark, sf_dir).select("row_id", represent.fact_lines("list").alias("listed"), represent.fact_lines("natural").alias("sentence"))


_BY_SUBJECT = f"with {FACTS_SQL} select subject as query_id, string_agg('(' || {_HUMAN('subject')} || ', ' || {_HUMAN('predicate')} || ', ' || {_HUMAN('object')} || ')', chr(10) order by row_id) as context from facts where subject is not null group by subject"


@_query(_BY_SUBJECT)
def context_per_entity(spark, sf_dir):
    rows = views.facts(spark, sf_dir).filter("subject is not null").withColumn("query_id", F.col("subject"))
    return represent.format_results(rows, "list", rank="row_id")


@_query(f"with {FACTS_SQL} select row_id, upper(left(predicate, 1)) || lower(substr(predicate, 2)) as capitalized, case when length(object) > 15 then left(object, 15) || '...' else object end as label from facts")
def label_texts(spark, sf_dir):
    from factloom.functions.text import capitalize_first

    return views.facts(spark, sf_dir).select("row_id", capitalize_first(F.col("predicate")).alias("capitalized"), truncated(F.col("object"), 15).alias("label"))


# --- scans and filters -------------------------------------------------------------------------------------------------------


@_query(f"with {FACTS_SQL} select subject, predicate, object from facts where {_FULL}")
def graph_keys(spark, sf_dir):
    return store.keys_of(views.facts(spark, sf_dir))


@_query(f"with {FACTS_SQL} select row_id, subject, predicate, object from facts where {_FULL} order by subject, predicate, object, row_id limit 5")
def graph_sample(spark, sf_dir):
    return filters.complete(views.facts(spark, sf_dir)).orderBy("subject", "predicate", "object", "row_id").limit(5).select("row_id", "subject", "predicate", "object")


@_query(f"with {FACTS_SQL} select row_id, predicate, object from facts where lower(subject) = lower('{ENTITY}')")
def by_subject(spark, sf_dir):
    return filters.by_subject(views.facts(spark, sf_dir), ENTITY).select("row_id", "predicate", "object")


@_query(f"with {FACTS_SQL} select row_id, subject, object from facts where lower(predicate) = 'directed_by'")
def by_relation(spark, sf_dir):
    return filters.by_relation(views.facts(spark, sf_dir), "Directed_By").select("row_id", "subject", "object")


@_query(f"with {TRADE_SQL} select subject, predicate, object, source from trade where lower(subject) = 'nation_0' or lower(object) = 'nation_0' order by subject, predicate, object limit 50")
def entity_lookup(spark, sf_dir):
    return filters.entity_lookup(views.trade(spark, sf_dir), "nation_0")


@_query(f"with {TRADE_SQL} select subject, predicate, object, source from trade where (lower(subject) = 'nation_0' or lower(object) = 'nation_0') and lower(predicate) = 'part_of' order by subject, predicate, object limit 50")
def entity_lookup_relation(spark, sf_dir):
    return filters.entity_lookup(views.trade(spark, sf_dir), "NATION_0", "Part_Of")


@_query(f"with {TRADE_SQL} select subject, predicate, object, source from trade where lower(subject) = '{SUPPLIER.lower()}' or lower(object) = '{SUPPLIER.lower()}' order by subject, predicate, object limit 50")
def f5_entity_lookup(spark, sf_dir):
    return filters.entity_lookup(views.trade(spark, sf_dir), SUPPLIER)


@_query(f"with {FACTS_SQL} select row_id from facts where lower(replace(predicate, ' ', '_')) in (select lower(replace(relation, ' ', '_')) from relation_schema where relation is not null)")
def schema_filter(spark, sf_dir):
    return filters.in_schema(views.facts(spark, sf_dir), views.table(spark, sf_dir, "relation_schema")).select("row_id")


@_query("select doc_id, contains(text, 'Archive') as cased, contains(lower(text), 'archive') as folded from documents where contains(lower(text), 'archive')")
def text_contains(spark, sf_dir):
    docs = filters.contains(views.table(spark, sf_dir, "documents"), "text", "archive", ignore_case=True)
    return docs.select("doc_id", F.contains("text", F.lit("Archive")).alias("cased"), F.contains(F.lower("text"), F.lit("archive")).alias("folded"))


# --- duplicates and set operations -------------------------------------------------------------------------------------------


@_query(
    f"with {FACTS_SQL}, n as (select row_id, replace(subject, '_', ' ') as subject, replace(predicate, '_', ' ') as predicate, replace(object, '_', ' ') as object from facts) "
    "select subject, predicate, object, min(row_id) as row_id from n group by subject, predicate, object"
)
def ordered_dedup(spark, sf_dir):
    rows = represent.normalize(views.facts(spark, sf_dir).select("row_id", "subject", "predicate", "object"))
    return dedup.first_occurrence(rows, ["subject", "predicate", "object"], "row_id")


@_query(f"with {FACTS_SQL} select distinct predicate from facts where predicate is not null")
def unique_relations(spark, sf_dir):
    return stats.unique_relations(views.facts(spark, sf_dir))


_STATUS = f"""with {FACTS_SQL}, {PROPOSED_SQL},
keyed as (select *, {_STRIP("coalesce(subject, '')")} as ks, {_STRIP("coalesce(predicate, '')")} as kp, {_STRIP("coalesce(object, '')")} as ko from proposed),
nth as (select *, row_number() over (partition by ks, kp, ko order by row_id) as n from keyed),
held as (select subject, predicate, object, {_STRIP("subject")} as ks, {_STRIP("predicate")} as kp, {_STRIP("object")} as ko from facts where {_FULL}),
raw as (select distinct subject, predicate, object from held), norm as (select distinct ks, kp, ko from held)
select nth.row_id, case when n > 1 or raw.subject is not null or norm.ks is not null then 'exact' else 'new' end as status
from nth left join raw on raw.subject = nth.subject and raw.predicate = nth.predicate and raw.object = nth.object
left join norm on norm.ks = nth.ks and norm.kp = nth.kp and norm.ko = nth.ko"""


@_query(_STATUS)
def candidate_status(spark, sf_dir):
    return dedup.check_duplicates(views.proposals(spark, sf_dir), views.facts(spark, sf_dir)).select("row_id", "status")


@_query(f"with {FACTS_SQL} select row_id, {_STRIP('subject')} as s, {_STRIP('predicate')} as p, {_STRIP('object')} as o from facts")
def compare_keys(spark, sf_dir):
    return views.facts(spark, sf_dir).select("row_id", *[compare_key(F.col(c)).alias(c[0]) for c in ("subject", "predicate", "object")])


_AGENT_KEY = f"replace(translate(lower({_DOC}), ' _()', ''), ',', '|')"


@_query(f"with {FACTS_SQL}, {PROPOSED_SQL} select {_AGENT_KEY} as key, min(row_id) as row_id from proposed where {_AGENT_KEY} not in (select {_AGENT_KEY} from facts) group by 1")
def unseen_proposals(spark, sf_dir):
    fresh = dedup.unseen(views.proposals(spark, sf_dir), views.facts(spark, sf_dir))
    return fresh.select(agent_key(represent.fact_string()).alias("key"), "row_id")


@_query(f"with {FACTS_SQL}, {PROPOSED_SQL} select row_id from proposed p where not exists (select 1 from facts f where f.subject = p.subject and f.predicate = p.predicate and f.object = p.object)")
def rejected_wins(spark, sf_dir):
    return dedup.rejected_wins(views.proposals(spark, sf_dir), views.facts(spark, sf_dir)).select("row_id")


@_query(f"with {FACTS_SQL}, {PROPOSED_SQL} select row_id, 'retrieved' as origin, 1.0::double as score from facts union all select row_id, 'expanded', 0.5::double from proposed")
def combined_results(spark, sf_dir):
    retrieved = views.facts(spark, sf_dir).withColumn("score", F.lit(1.0))
    return dedup.combine_retrieved(retrieved, views.proposals(spark, sf_dir)).select("row_id", "origin", "score")


_UPSERT = f"""with {FACTS_SQL}, {PROPOSED_SQL}, merged as (select 0 as b, row_id, subject, predicate, object, source from facts where {_FULL} union all select 1, row_id, subject, predicate, object, 'llm_expanded' from proposed where {_FULL})
select subject, predicate, object, row_id, source from merged qualify row_number() over (partition by subject, predicate, object order by b desc, row_id desc) = 1"""


@_query(_UPSERT)
def upsert_facts(spark, sf_dir):
    old = views.facts(spark, sf_dir).drop("source_text")
    fresh = views.proposals(spark, sf_dir).withColumn("source", F.lit("llm_expanded"))
    return store.upserted(old, fresh).select("subject", "predicate", "object", "row_id", "source")


@_query(f"with {FACTS_SQL} select count(*) filter ({_FULL}) as migrated, count(*) filter (not ({_FULL})) as skipped from facts")
def migration_report(spark, sf_dir):
    rows = views.facts(spark, sf_dir)
    return store.migrate(rows, rows.limit(0))[1]


@_query(
    f"with {FACTS_SQL}, {PROPOSED_SQL} select distinct {_STRIP('subject')} as subject, {_STRIP('predicate')} as predicate, {_STRIP('object')} as object from proposed where {_FULL} "
    f"except select {_STRIP('subject')}, {_STRIP('predicate')}, {_STRIP('object')} from facts where {_FULL}"
)
def migration_missing(spark, sf_dir):
    return store.missing_after(views.proposals(spark, sf_dir), views.facts(spark, sf_dir))


# --- counts and rankings -----------------------------------------------------------------------------------------------------


@_query("select count(*) as n from triplets")
def store_size(spark, sf_dir):
    return views.facts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {FACTS_SQL} select predicate, count(*) as n from facts where predicate is not null group by predicate order by n desc, predicate limit 10")
def predicate_histogram(spark, sf_dir):
    return stats.top_counts(views.facts(spark, sf_dir), "predicate")


@_query("select count(distinct subject) as subjects, count(distinct obj) as objects from triplets")
def distinct_ends(spark, sf_dir):
    return stats.distinct_counts(views.facts(spark, sf_dir))


@_query("select coalesce(source, 'original') as source, count(*) as n from triplets group by 1")
def source_counts(spark, sf_dir):
    return stats.source_counts(views.facts(spark, sf_dir))


@_query(f"with {GRAPH_SQL} select 'person' as label, count(*) as n from person union all select 'movie', count(*) from movie union all select 'acted_in', count(*) from acted_in union all select 'directed', count(*) from directed")
def label_counts(spark, sf_dir):
    g = views.movie_graph(spark, sf_dir)
    return stats.label_counts(person=g.person, movie=g.movie, acted_in=g.acted_in, directed=g.directed)


@_query("select intent, count(*) as n from training_examples group by intent")
def intent_distribution(spark, sf_dir):
    return views.table(spark, sf_dir, "training_examples").groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@_query("select event_id, user_id, event_type from (select * from events order by event_id desc limit 10)")
def last_history(spark, sf_dir):
    return stats.last_rows(views.table(spark, sf_dir, "events"), "event_id").select("event_id", "user_id", "event_type")


_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda w: w <> ''))"


@_query(
    f"""with q as (select question as query_id, unnest({_WORDS("question")}) as word from (select distinct question from training_examples where question is not null)),
r as (select relation, unnest({_WORDS("replace(relation, '_', ' ')")}) as word, 3 as points from relation_schema union all select relation, unnest({_WORDS("description")}), 1 from relation_schema)
select query_id, relation, sum(points)::bigint as score from q join r using (word) group by query_id, relation qualify row_number() over (partition by query_id order by sum(points) desc, relation) <= 50"""
)
def relation_relevance(spark, sf_dir):
    questions = views.table(spark, sf_dir, "training_examples").select(F.col("question").alias("query_id"), F.col("question").alias("query")).filter("query is not null").distinct()
    scored = stats.relation_relevance(questions, views.table(spark, sf_dir, "relation_schema"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "relation")
    return scored.withColumn("n", F.row_number().over(order)).filter("n <= 50").drop("n")


_KNOWN = f"""with {FACTS_SQL}, q as (select distinct source as query_id, predicate from facts where source is not null and predicate is not null),
a as (select query_id, unnest({_WORDS("replace(query_id, '_', ' ')")}) as word from (select distinct query_id from q)),
r as (select relation, unnest({_WORDS("replace(relation, '_', ' ')")}) as word, 3 as points from relation_schema union all select relation, unnest({_WORDS("description")}), 1 from relation_schema),
hit as (select distinct query_id, relation, lower(relation) as k from (select query_id, lower(replace(predicate, '_', ' ')) as k from q) p join (select distinct relation from relation_schema) s on lower(s.relation) = p.k),
p as (select query_id, relation, points from a join r using (word) union all select query_id, relation, 10 from hit)
select query_id, relation, sum(points)::bigint as score from p group by query_id, relation"""


@_query(_KNOWN)
def relation_relevance_known(spark, sf_dir):
    """Relations for every source as the question, with the predicates of its facts as known ones."""
    rows = views.facts(spark, sf_dir).filter("source is not null and predicate is not null").select(F.col("source").alias("query_id"), "predicate")
    asked = rows.select("query_id", F.translate("query_id", "_", " ").alias("query")).distinct()
    return stats.relation_relevance(asked, views.table(spark, sf_dir, "relation_schema"), rows)


@_query(
    f"with {FACTS_SQL}, {PROPOSED_SQL}, a as (select distinct {_STRIP('subject')} as s, {_STRIP('predicate')} as p, {_STRIP('object')} as o from proposed where {_FULL}), b as (select distinct {_STRIP('subject')} as s, {_STRIP('predicate')} as p, {_STRIP('object')} as o from facts where {_FULL}), "
    "m as (select count(*) as missing from (select * from a except select * from b)) select (select count(*) from a) as source_keys, (select count(*) from b) as target_keys, missing, round(((select count(*) from a) - missing) / (select count(*) from a), 6) as ratio from m"
)
def migration_verified(spark, sf_dir):
    return store.verify(views.proposals(spark, sf_dir), views.facts(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


# --- vectors -----------------------------------------------------------------------------------------------------------------

_DOT = "round(list_dot_product(q.embedding::double[], i.embedding::double[]), 6)"
_TOP = lambda k: f"""with scored as (select q.vec_id as query_id, i.vec_id, {_DOT} as score from embeddings q, embeddings i where q.vec_id % 100 = 0),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id) - 1)::int as rank from scored)
select query_id, vec_id, score, rank from ranked where rank < {k}"""  # noqa: E731


def _asked(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_query(_TOP(5))
def vector_topk(spark, sf_dir):
    return vector.top_k(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"), 5)


@_query(f"select * from ({_TOP(5)}) where score >= 0.3")
def vector_min_score(spark, sf_dir):
    return filters.at_least(vector.top_k(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"), 5), 0.3)


@_query(f"select * from ({_TOP(5)}) where score >= 0.4")
def vector_find_similar(spark, sf_dir):
    return vector.find_similar(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"), 0.4)


@_query(f"select query_id, score >= 0.95 as has_similar from ({_TOP(1)})")
def vector_has_similar(spark, sf_dir):
    return vector.has_similar(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"))


@_query("select i.vec_id, " + _DOT + " as score, (row_number() over (order by " + _DOT + " desc, i.vec_id) - 1)::int as rank from embeddings i, (select * from embeddings where vec_id = (select min(vec_id) from embeddings)) q order by score desc, i.vec_id limit 10")
def vector_search_one(spark, sf_dir):
    items = views.table(spark, sf_dir, "embeddings")
    first = items.orderBy("vec_id").limit(1).select("embedding").first()
    return vector.search_one(items, first[0], 10)


@_query(
    """select q.vec_id as query_id, i.vec_id, round(list_dot_product(q.embedding::double[], i.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(i.embedding::double[], i.embedding::double[])) + 1e-8), 6) as score
from embeddings q, embeddings i where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by score desc, i.vec_id) <= 3"""
)
def vector_cosine(spark, sf_dir):
    return vector.top_k(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"), 3, measure="cosine").select("query_id", "vec_id", "score")


@_query(_TOP(3).replace(_DOT, "round((1 + list_dot_product(q.embedding::double[], i.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(i.embedding::double[], i.embedding::double[])) + 1e-8)) / 2, 6)"))
def vector_scaled(spark, sf_dir):
    return vector.top_k(_asked(spark, sf_dir), views.table(spark, sf_dir, "embeddings"), 3, measure="scaled")


_SIMILAR = f"""with {FACTS_SQL}, cand as (select 'n' || vec_id as subject, 'is' as predicate, 'v' as object, vec_id as row_id, embedding from embeddings where vec_id % 100 = 0),
best as (select q.row_id, max(round(list_dot_product(q.embedding::double[], i.embedding::double[]), 6)) as similarity from cand q join embeddings i on i.vec_id <> q.row_id group by q.row_id)
select row_id, case when similarity >= 0.4 then 'semantic' else 'new' end as status, case when similarity >= 0.4 then similarity end as similarity from cand join best using (row_id)"""


@_query(_SIMILAR)
def semantic_status(spark, sf_dir):
    """Candidates against a store by similarity: every hundredth vector against all others, none of them an exact duplicate."""
    items = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = items.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "row_id")
    best = vector.top_k(asked, items, 2, query_id="row_id").filter("row_id <> vec_id").groupBy("row_id").agg(F.max("score").alias("similarity"))
    candidates = asked.select("row_id", F.concat(F.lit("n"), "row_id").alias("subject"), F.lit("is").alias("predicate"), F.lit("v").alias("object"))
    return dedup.check_duplicates(candidates, views.facts(spark, sf_dir), similar=best, threshold=0.4).select("row_id", "status", "similarity")


@_query(f"with {FACTS_SQL} select row_id, '| ' || {_HUMAN('subject')} || ' | ' || {_HUMAN('predicate')} || ' | ' || {_HUMAN('object')} || ' | ' || printf('%.3f', (row_id % 4) / 4.0) || ' |' as cells, '[' || printf('%.2f', (row_id % 4) / 4.0) || '] (' || {_HUMAN('subject')} || ', ' || {_HUMAN('predicate')} || ', ' || {_HUMAN('object')} || ')' as scored from facts")
def scored_lines(spark, sf_dir):
    """Facts as table rows and with scores, in quarters, which every engine rounds alike."""
    rows = views.facts(spark, sf_dir).withColumn("score", F.col("row_id") % 4 / 4.0)
    return rows.select("row_id", represent.fact_lines("table").alias("cells"), represent.fact_lines("scored").alias("scored"))


# --- graph -------------------------------------------------------------------------------------------------------------------

_EXPAND = (
    "with recursive "
    + TRADE_SQL
    + """, adj as (select lower(subject) as ent, lower(object) as nxt from trade union select lower(object), lower(subject) from trade),
fr as (select 'nation_0' as ent, 0 as hop union select adj.nxt, fr.hop + 1 from fr join adj on adj.ent = fr.ent where fr.hop < 2),
ent as (select ent, min(hop) as h from fr group by ent),
hit as (select t.subject, t.predicate, t.object, t.source, least(coalesce(a.h, 99), coalesce(b.h, 99)) + 1 as hop from trade t left join ent a on a.ent = lower(t.subject) left join ent b on b.ent = lower(t.object))
select subject, predicate, object, source, hop::int as hop from hit where hop <= 2"""
)


@_query(_EXPAND)
def expansion(spark, sf_dir):
    # the facts are computed from five tables, so they are written once and not computed for every hop
    return graph.expand(spool(views.trade(spark, sf_dir), "trade"), "NATION_0", 2, None)


@_query(f"select * from ({_EXPAND}) order by hop, subject, predicate, object limit 100")
def expansion_limited(spark, sf_dir):
    return graph.expand(views.trade(spark, sf_dir), "NATION_0", 2, 100)


@_query(f"with expanded as ({_EXPAND}) select subject as entity from expanded union select object from expanded")
def expansion_entities(spark, sf_dir):
    return graph.unique_entities(graph.expand(views.trade(spark, sf_dir), "NATION_0", 2, None))


@_query(
    f"""with recursive {GRAPH_SQL}, e as (select 'p:' || name as a, 'm:' || title as b from acted_in join person using (person_id) join movie using (movie_id)),
adj as (select a, b from e union select b, a from e),
fr as (select 'p:{SUPPLIER}' as node, 0 as d union select adj.b, fr.d + 1 from fr join adj on adj.a = fr.node where fr.d < 6)
select min(d)::int as length from fr where node = 'p:Supplier#000000007'"""
)
def path_length(spark, sf_dir):
    return movies.path_between(views.movie_graph(spark, sf_dir), SUPPLIER, "Supplier#000000007").select("length")


_PAIRS = f"""with {FACTS_SQL}, first as (select subject, object, predicate, min(row_id) as r from facts where subject is not null and object is not null group by all),
src as (select subject, object, arg_min_null(source, row_id) as source from facts where subject is not null and object is not null group by all)
select subject, object, string_agg(predicate, '|' order by r) as predicates, any_value(source) as source from first join src using (subject, object) group by subject, object"""


@_query(_PAIRS)
def collapsed_pairs(spark, sf_dir):
    pairs = graph.pair_edges(views.facts(spark, sf_dir))
    return pairs.select("subject", "object", F.when(F.size(F.array_compact("predicates")) > 0, F.array_join("predicates", "|")).alias("predicates"), "source")


@_query(f"select subject, object, case when length(l) > 15 then left(l, 12) || '...' else l end as label from (select subject, object, coalesce(replace(predicates, '|', ', '), '') as l from ({_PAIRS}))")
def edge_labels(spark, sf_dir):
    return graph.pair_edges(views.facts(spark, sf_dir)).select("subject", "object", graph.edge_label(F.col("predicates"), 15).alias("label"))


_DEGREE = f"with {FACTS_SQL}, pairs as (select distinct subject, object from facts where subject is not null and object is not null), degree as (select node, count(*) as degree from (select subject as node from pairs union all select object from pairs) group by node)"


@_query(f"{_DEGREE} select node, degree from degree")
def node_degrees(spark, sf_dir):
    return graph.degrees(views.facts(spark, sf_dir))


@_query(f"{_DEGREE} select node, degree from degree order by degree desc, node limit 5")
def top_nodes(spark, sf_dir):
    return graph.degrees(views.facts(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(5)


@_query(
    f"{_DEGREE}, b as (select min(degree) as lo, max(degree) as hi, count(*) as n from degree) select node, degree, round((degree - lo) / (hi - lo), 6) as norm, round(300 + degree / hi * 300 * 3, 6) as size, round(degree / (n - 1), 6) as centrality from degree, b"
)
def node_measures(spark, sf_dir):
    rows = graph.scaled_degrees(graph.degrees(views.facts(spark, sf_dir)))
    return rows.select("node", "degree", *[F.round(c, 6).alias(c) for c in ("norm", "size", "centrality")])


@_query(f"{_DEGREE}, m as (select degree as cut from degree order by degree limit 1 offset (select count(*) // 2 from degree)) select node, case when length(node) > 15 then left(node, 15) || '...' else node end as label from degree, m where degree >= cut")
def node_labels(spark, sf_dir):
    return graph.labelled_nodes(graph.degrees(views.facts(spark, sf_dir)))


_COMPONENTS = f"""with recursive {GRAPH_SQL}, e as (select cast(person_id as varchar) as a, 'm' || movie_id as b from directed), adj as (select a, b from e union select b, a from e),
reach as (select a as node, a as other from adj union select reach.node, adj.b from reach join adj on adj.a = reach.other) select node, min(other) as component from reach group by node"""


@_query(_COMPONENTS)
def connected_components(spark, sf_dir):
    edges = views.movie_graph(spark, sf_dir).directed.select(F.col("person_id").cast("string").alias("subject"), F.concat(F.lit("m"), F.col("movie_id").cast("string")).alias("object"))
    return graph.components(edges)


@_query(
    """with recursive e as (select n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey union select r1.r_name, r2.r_name from region r1, region r2 where r1.r_regionkey < r2.r_regionkey),
adj as (select a, b from e union select b, a from e), d as (select a as s, a as t, 0 as n from adj union select d.s, adj.b, d.n + 1 from d join adj on adj.a = d.t where d.n < 4)
select round(avg(n), 6) as average_length from (select s, t, min(n) as n from d where s <> t group by s, t)"""
)
def average_path(spark, sf_dir):
    nation, region = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.col("r_name").alias("object"))
    ring = region.alias("x").join(region.alias("y"), F.col("x.r_regionkey") < F.col("y.r_regionkey")).select(F.col("x.r_name").alias("subject"), F.col("y.r_name").alias("object"))
    return graph.average_path_length(edges.unionByName(ring)).select(F.round("average_length", 6).alias("average_length"))


@_query(
    f"with {FACTS_SQL}, f as (select * from facts where subject is not null and object is not null) select 'nodes' as measure, count(*) as value from (select subject from f union select object from f) union all select 'edges', count(*) from (select distinct subject, object from f) union all select 'facts', count(*) from f"
)
def graph_measures(spark, sf_dir):
    return graph.graph_report(views.facts(spark, sf_dir)).filter("measure <> 'components'")


def played_edges(g: movies.MovieGraph) -> DataFrame:
    """(``subject``, ``object``): persons and movies ('m' before the key) of all ACTED_IN and DIRECTED edges."""
    both = g.acted_in.select("person_id", "movie_id").unionByName(g.directed.select("person_id", "movie_id"))
    return both.select(F.col("person_id").cast("string").alias("subject"), F.concat(F.lit("m"), F.col("movie_id").cast("string")).alias("object")).distinct()


@_query(None)
def movie_graph_components(spark, sf_dir):
    """Components over all edges of the movie graph; recursive SQL is too slow for it, so it has none."""
    return graph.components(played_edges(views.movie_graph(spark, sf_dir)))


@_query(None)
def graph_measures_whole(spark, sf_dir):
    """All rows of the report, the number of components included."""
    return graph.graph_report(views.facts(spark, sf_dir))


# --- movie graph -------------------------------------------------------------------------------------------------------------

_ACTED = "acted_in join person using (person_id) join movie using (movie_id)"
_LED = "directed join person using (person_id) join movie using (movie_id)"


def _movie(name: str, sql: str, build: Callable) -> None:
    def query(spark, sf_dir):
        return build(views.movie_graph(spark, sf_dir))

    QUERIES[name] = query
    ORACLES[name] = f"with {GRAPH_SQL} {sql}"


_TITLE = "(select min(title) from movie)"
_movie("find_movies_by_actor", f"select title as movie, year from {_ACTED} where name = '{SUPPLIER}'", lambda g: movies.movies_of(g, SUPPLIER))
_movie("find_movies_by_director", f"select title as movie, year from {_LED} where name = '{SUPPLIER}'", lambda g: movies.directed_by(g, SUPPLIER))
_movie("find_actors_in_movie", f"select name as actor, role from {_ACTED} where title = {_TITLE}", lambda g: movies.actors_of(g, g.movie.agg(F.min("title")).first()[0]))
_movie("find_director", f"select name as director from {_LED} where title = {_TITLE}", lambda g: movies.director_of(g, g.movie.agg(F.min("title")).first()[0]))
_movie("find_movies_by_year", "select title as movie, year from movie where year = 2010", lambda g: movies.movies_in_year(g, 2010))
_movie("find_movies_since_year", "select title as movie, year from movie where year >= 2020", lambda g: movies.movies_in_year(g, 2020, since=True))
_movie("find_movies_by_genre", "select title as movie, year from movie where contains(lower(genre), lower('Standard'))", lambda g: movies.movies_in_genre(g, "Standard"))
_movie("find_movies_of_genre", "select title as movie, year from movie where genre = (select min(genre) from movie)", lambda g: movies.movies_of_genre(g, g.movie.agg(F.min("genre")).first()[0]))
_movie("latest_movies", "select title as movie, genre, year from movie order by year desc nulls first, title limit 20", lambda g: movies.latest_movies(g))
_movie("count_all_movies", "select count(*) as movie_count from movie", lambda g: movies.count_movies(g))
_movie("find_actors_in_part_of_title", f"select name as actor, role from {_ACTED} where contains(title, 'lime')", lambda g: movies.actors_of(g, "lime", exact=False))
_movie("find_movies_by_part_of_actor", f"select title as movie, year from {_ACTED} where contains(name, '#00000000')", lambda g: movies.movies_of(g, "#00000000", exact=False))
_movie("find_movies_by_part_of_director", f"select title as movie, year from {_LED} where contains(name, '#00000000')", lambda g: movies.directed_by(g, "#00000000", exact=False))
_movie("find_director_by_part_of_title", f"select name as director from {_LED} where contains(title, 'lime')", lambda g: movies.director_of(g, "lime", exact=False))
_movie("find_release_year_by_part", "select title as movie, year from movie where contains(title, 'lime')", lambda g: movies.release_year(g, "lime", exact=False))
_movie("genre_edges", "select movie_id, genre as genre_id from movie where genre is not null", lambda g: movies.in_genre(g))
_movie("find_release_year", f"select title as movie, year from movie where title = {_TITLE}", lambda g: movies.release_year(g, g.movie.agg(F.min("title")).first()[0]))
_movie("count_movies", f"select count(*) as movie_count from acted_in join person using (person_id) where name = '{SUPPLIER}'", lambda g: movies.count_movies(g, SUPPLIER))
_movie("count_movies_absent", "select count(*) as movie_count from acted_in join person using (person_id) where name = 'nobody'", lambda g: movies.count_movies(g, "nobody"))
_movie(
    "find_coactors",
    f"select distinct p2.name as coactor, title as movie from acted_in a join person p1 on a.person_id = p1.person_id and p1.name = '{SUPPLIER}' join acted_in b on a.movie_id = b.movie_id and a.person_id <> b.person_id join person p2 on b.person_id = p2.person_id join movie on movie.movie_id = a.movie_id",
    lambda g: movies.coactors(g, SUPPLIER),
)
_movie(
    "bipartite_graph",
    f"select name, title, case when d.person_id is not null then 'DIRECTED' else 'ACTED_IN' end as relationship, coalesce(genre, 'Unknown') as genre from acted_in a full join directed d using (person_id, movie_id) join person using (person_id) join movie using (movie_id)",
    movies.bipartite,
)
_movie("genre_subgraph", "select name, title, case when d.person_id is not null then 'DIRECTED' else 'ACTED_IN' end as relationship, genre from acted_in a full join directed d using (person_id, movie_id) join person using (person_id) join movie using (movie_id) where genre = (select min(genre) from movie)", lambda g: movies.genre_subgraph(g, g.movie.agg(F.min("genre")).first()[0]))
_movie("person_movie_edges", f"select name, 'ACTED_IN' as relationship, title, genre from {_ACTED} union all select name, 'DIRECTED', title, genre from {_LED}", lambda g: movies._played(g, g.acted_in).select("name", F.lit("ACTED_IN").alias("relationship"), "title", "genre").unionByName(movies._played(g, g.directed).select("name", F.lit("DIRECTED").alias("relationship"), "title", "genre")))
_movie("entity_dictionary", "select 'person' as kind, name from person union all select 'movie', title from movie", lambda g: g.person.select(F.lit("person").alias("kind"), "name").unionByName(g.movie.select(F.lit("movie").alias("kind"), F.col("title").alias("name"))))

_SEQ = "seq as (select *, row_number() over (order by movie_title nulls first, person_name nulls first, release_year nulls first, genre nulls first, role nulls first) as row_id from movie_credits)"


def _credits(spark, sf_dir):
    return movies.import_credits(views.table(spark, sf_dir, "movie_credits").withColumn("row_id", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "release_year" else F.coalesce(c, F.lit(-1)) for c in views.CREDIT_ORDER])), "row_id")


@_query(f"with {_SEQ} select movie_title as title, arg_min_null(release_year, row_id) as year, arg_min_null(genre, row_id) as genre from seq where movie_title is not null group by movie_title")
def import_movies(spark, sf_dir):
    return _credits(spark, sf_dir).movie.select("title", "year", "genre")


@_query(f"with {_SEQ} select person_name as name, movie_title as title, arg_max_null(role, row_id) as role from seq where person_name is not null and movie_title is not null group by all")
def import_roles(spark, sf_dir):
    return _credits(spark, sf_dir).acted_in.select(F.col("person_id").alias("name"), F.col("movie_id").alias("title"), "role")


# --- questions ---------------------------------------------------------------------------------------------------------------


@_query(
    """select question, array_to_string(regexp_extract_all(question, '\\b(19\\d{2}|20\\d{2})\\b'), ',') as years, array_to_string(regexp_extract_all(question, '"([^"]+)"', 1), ',') as quoted from (select distinct question from training_examples where question is not null)"""
)
def question_mentions(spark, sf_dir):
    rows = views.table(spark, sf_dir, "training_examples").select("question").filter("question is not null").distinct()
    return rows.select("question", F.array_join(F.transform(years_in(F.col("question")), lambda y: y.cast("string")), ",").alias("years"), F.array_join(quoted_in(F.col("question")), ",").alias("quoted"))


@_query("select doc_id, regexp_extract(f, '\\(([^,]+),\\s*([^,]+),\\s*([^)]+)\\)', 1) as s from (select doc_id, unnest(regexp_extract_all(text, '\\([^,]+,\\s*[^,]+,\\s*[^)]+\\)')) as f from documents)".replace("as s from", "as raw from").replace("select doc_id, regexp_extract", "select doc_id, count(*) as facts from (select doc_id, regexp_extract") + ") group by doc_id")
def facts_in_documents(spark, sf_dir):
    return files.facts_in_column(views.table(spark, sf_dir, "documents"), "text", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts"))
