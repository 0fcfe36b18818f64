"""Tools over a store of facts, called by name with JSON arguments and answering in JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.filters import entity_lookup
from factloom.operators.graph import expand
from factloom.plans import cypher, rendering
from factloom.plans.models import ChatModel, Embedder
from factloom.plans.retrieval import expand_facts, retrieve, stored_index
from factloom.plans.validation import Checked, Validation, validate
from factloom.sources.files import facts_in_text
from factloom.sources.store import FactStore


def clamp(value, low: int, high: int, default: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def _tool(name: str, description: str, required: list[str], **properties: tuple[str, str]) -> dict:
    return {"name": name, "description": description, "parameters": {"type": "object", "properties": {k: {"type": t, "description": d} for k, (t, d) in properties.items()}, "required": required}}


# Names of the tools and of their parameters, which calls refer to.
TOOLS = [
    _tool("search_knowledge_graph", "Facts similar to a question.", ["query"], query=("string", "the question"), top_k=("integer", "1 to 20, usually 5")),
    _tool("query_entity", "Facts about an entity.", ["entity"], entity=("string", "its name"), relationship=("string", "only this relation")),
    _tool("expand_entity", "Facts around an entity.", ["entity"], entity=("string", "its name"), depth=("integer", "1 to 3, usually 2"), max_results=("integer", "1 to 100, usually 20")),
    _tool("run_cypher", "Run a reading graph query.", ["query"], query=("string", "MATCH ... RETURN ...")),
    _tool("expand_triplets", "Let a model propose facts beyond known ones.", ["query", "facts"], query=("string", "the question"), facts=("string", "known facts as (s, p, o)"), max_new_triplets=("integer", "1 to 15, usually 5"), persist=("boolean", "store them")),
    _tool("validate_and_persist_triplets", "Let a model check facts and store the accepted ones.", ["query", "triplets"], query=("string", "the question"), triplets=("string", "facts as (s, p, o)"), skip_validation=("boolean", "store unchecked")),
]


class Toolbox:
    """Dispatches tool calls; every failure is an error in JSON, never an exception."""

    def __init__(self, spark: SparkSession, store: FactStore, embedder: Embedder, model: ChatModel | None = None, schema: DataFrame | None = None, allow_cypher: bool = True):
        self.spark, self.store, self.embedder, self.model, self.schema, self.allow_cypher = spark, store, embedder, model, schema, allow_cypher

    def tools(self) -> list[dict]:
        return TOOLS if self.allow_cypher else TOOLS[:3]

    def call(self, name: str, arguments: dict) -> str:
        handler: Callable | None = getattr(self, f"_{name}", None) if name in {t["name"] for t in self.tools()} else None
        if handler is None:
            return rendering.error_json(f"unknown tool {name}")
        try:
            return handler(arguments or {})
        except Exception as failure:  # a tool's failure is its answer
            return rendering.error_json(str(failure).splitlines()[0] if str(failure) else type(failure).__name__)

    def _facts(self) -> DataFrame:
        return self.store.read().select("row_id", "subject", "predicate", "object", "source")

    def _search_knowledge_graph(self, a: dict) -> str:
        asked = self.spark.createDataFrame([("q", str(a["query"]))], "query_id string, query string")
        hits = retrieve(asked, stored_index(self.store.read(), self.embedder), self.embedder, clamp(a.get("top_k", 5), 1, 20, 5))
        return rendering.facts_json(a["query"], [r.asDict() for r in hits.orderBy("rank").collect()])

    def _query_entity(self, a: dict) -> str:
        rows = entity_lookup(self._facts(), str(a["entity"]), a.get("relationship"), 50)
        return rendering.facts_json(a["entity"], [r.asDict() for r in rows.collect()])

    def _expand_entity(self, a: dict) -> str:
        rows = expand(self._facts(), str(a["entity"]), clamp(a.get("depth", 2), 1, 3, 2), clamp(a.get("max_results", 20), 1, 100, 20))
        return rendering.facts_json(a["entity"], [r.asDict() for r in rows.collect()])

    def _run_cypher(self, a: dict) -> str:
        facts = self._facts().withColumn("id", F.concat_ws("|", "subject", "predicate", "object"))
        rows = cypher.compile_query(str(a["query"]), cypher.Schema({"Triplet": (facts, "id")}, {})).limit(50).collect()
        import json

        return json.dumps({"num_results": len(rows), "results": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, default=str)

    def persist(self, checked: list[Checked], source: str) -> int:
        """Upsert accepted facts with what the validation said of them; returns how many were written."""
        if not checked:
            return 0
        start = self._facts().agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        rows = [(start + 1 + k, *c.fact, source, c.status, c.reason) for k, c in enumerate(checked)]
        self.store.upsert(self.spark.createDataFrame(rows, "row_id long, subject string, predicate string, object string, source string, status string, reason string"))
        return len(rows)

    def _expand_triplets(self, a: dict) -> str:
        import json

        known = facts_in_text(str(a.get("facts", "")))
        if not known:
            return rendering.error_json("no facts of the form (s, p, o)")
        proposed = expand_facts(str(a["query"]), known, self.schema, self.model, self.spark, clamp(a.get("max_new_triplets", 5), 1, 15, 5))
        stored = self.persist([Checked(f, "expanded") for f in proposed], "llm_expanded") if a.get("persist") else 0
        return json.dumps({"query": a["query"], "new_triplets": proposed, "persisted_count": stored})

    def _validate_and_persist_triplets(self, a: dict) -> str:
        import json

        facts = facts_in_text(str(a.get("triplets", "")))
        if not facts:
            return rendering.error_json("no facts of the form (s, p, o)")
        if a.get("skip_validation"):
            result = Validation(query=str(a["query"]), accepted=[Checked(f, "validated") for f in facts], model="skipped")
        else:
            result = validate(facts, str(a["query"]), self.model)
        return json.dumps(result.to_dict() | {"persisted_count": self.persist(result.accepted, "remote_validated")})
