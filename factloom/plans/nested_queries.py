"""Queries on nested agent records (problem 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.nested import AGENT_RUN, RUN_COLUMNS, element_places, flatten_records


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/agent_results.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_places(_records(spark, sf_dir), "record", "run_id", AGENT_RUN)


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_records(_records(spark, sf_dir), "record", "run_id", AGENT_RUN, RUN_COLUMNS)[name]

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_runs": _table("runs"),
    "p3_tool_calls": _table("tool_calls"),
    "p3_returned_facts": _table("tool_calls.facts"),
    "p3_validation_attempts": _table("validation_history"),
    "p3_proposed_triplets": _table("validation_history.proposed"),
    "p3_validated_in_attempt": _table("validation_history.validated"),
    "p3_rejected_in_attempt": _table("validation_history.rejected"),
    "p3_final_triplets": _table("validated_triplets"),
}

_RUNS = "runs as (select run_id, min(record)::json as j from agent_results where json_valid(record) and json_type(case when json_valid(record) then record end) = 'OBJECT' group by run_id)"


def _top(list_name: str) -> str:
    return f"""{list_name} as (select run_id, unnest(items) as e, generate_subscripts(items, 1) - 1 as pos from (select run_id,
      case json_type(j, '$.{list_name}') when 'ARRAY' then json_extract(j, '$.{list_name}[*]') when 'OBJECT' then [json_extract(j, '$.{list_name}')] end as items from runs))"""


def _sub(parent: str, name: str, holder: str = "e") -> str:
    return f"""{name} as (select run_id, pos, unnest(items) as e, generate_subscripts(items, 1) - 1 as sub_pos from (select run_id, pos,
      case json_type({holder}, '$.{name}') when 'ARRAY' then json_extract({holder}, '$.{name}[*]') when 'OBJECT' then [json_extract({holder}, '$.{name}')] end as items
      from (select *, case json_type(e, '$.result') when 'VARCHAR' then (case when json_valid(e->>'$.result') then (e->>'$.result')::json end) else e->'$.result' end as res from {parent})))"""


_WITH = f"with {_RUNS}, {_top('tool_calls')}, {_top('validation_history')}, {_top('validated_triplets')}, {_sub('tool_calls', 'facts', 'res')}, {_sub('validation_history', 'proposed')}, {_sub('validation_history', 'validated')}, {_sub('validation_history', 'rejected')}"
_HELD = "json_type(e) <> 'NULL'"
#: Objects are written with their keys in order, as a variant holds them.
_SORTED_ARGUMENTS = (
    "case when json_type(e, '$.arguments') = 'OBJECT' then '{' || array_to_string(list_transform(list_sort(json_keys(e, '$.arguments')), "
    "lambda k: to_json(k)::varchar || ':' || json_extract(e, '$.arguments.\"' || k || '\"')::varchar), ',') || '}' else e->>'$.arguments' end"
)
_CHECKED_SQL = "e->>'$.triplet' as triplet, e->>'$.status' as status, e->>'$.reason' as reason, e->>'$.original' as original"

ORACLES: dict[str, str] = {
    "p3_found": f"{_WITH} "
    + " union all ".join(
        [f"select run_id, '{t}' as child, pos::bigint as pos, -1::bigint as sub_pos from {t} where {_HELD}" for t in ("tool_calls", "validation_history", "validated_triplets")]
        + [f"select run_id, '{p}.{t}', pos::bigint, sub_pos::bigint from {t} where {_HELD}" for p, t in (("tool_calls", "facts"), ("validation_history", "proposed"), ("validation_history", "validated"), ("validation_history", "rejected"))]
    ),
    "p3_runs": f"with {_RUNS} select run_id, j->>'$.query' as query, j->>'$.answer' as answer, try_cast(j->>'$.iterations' as int) as iterations, j->>'$.warning' as warning, j->>'$.llm_assessment.assessment' as assessment, try_cast(j->>'$.llm_assessment.confidence' as double) as confidence from runs",
    "p3_returned_facts": f"{_WITH} select run_id, pos::bigint as pos, sub_pos::bigint as sub_pos, e->>'$.subject' as subject, e->>'$.predicate' as predicate, e->>'$.object' as object, e->>'$.fact' as fact, try_cast(e->>'$.score' as double) as score from facts where {_HELD}",
    "p3_validation_attempts": f"{_WITH} select run_id, pos::bigint as pos, try_cast(e->>'$.attempt' as int) as attempt, try_cast(e->>'$.all_rejected' as boolean) as all_rejected, e->>'$.remote_model' as remote_model from validation_history where {_HELD}",
    "p3_rejected_in_attempt": f"{_WITH} select run_id, pos::bigint as pos, sub_pos::bigint as sub_pos, e->>'$.triplet' as triplet, e->>'$.reason' as reason from rejected where {_HELD}",
    "p3_tool_calls": f"{_WITH} select run_id, pos::bigint as pos, try_cast(e->>'$.iteration' as int) as iteration, e->>'$.tool' as tool, {_SORTED_ARGUMENTS} as arguments, try_cast(e->>'$.knowledge_iteration' as int) as knowledge_iteration from tool_calls where {_HELD}",
    "p3_proposed_triplets": f"{_WITH} select run_id, pos::bigint as pos, sub_pos::bigint as sub_pos, e->>'$' as triplet from proposed where {_HELD}",
    "p3_validated_in_attempt": f"{_WITH} select run_id, pos::bigint as pos, sub_pos::bigint as sub_pos, {_CHECKED_SQL} from validated where {_HELD}",
    "p3_final_triplets": f"{_WITH} select run_id, pos::bigint as pos, {_CHECKED_SQL} from validated_triplets where {_HELD}",
}
