"""The same questions as DuckDB SQL, where SQL can express them."""

from __future__ import annotations


def _key(column: str) -> str:
    return f"nullif(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


_TERMS = f"""with keyed as (select {_key("predicate")} as term, line_no from triplets),
total as (select count(distinct line_no) as all_records from triplets),
counted as (select term, count(*) as occurrences, count(distinct line_no) as records from keyed where term is not null group by term),
marked as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.1 * all_records then 'common' end as mark from counted, total)"""

_FACTS = f"""with payloads as (
  select triplet_id, case when json_valid(payload) then payload::json when json_valid(replace(payload, '''', '"')) and payload like '[%' then replace(payload, '''', '"')::json end as j from raw_triplets),
facts as (
  select triplet_id, {_key("subject")} as s, {_key("predicate")} as p, {_key("obj")} as o from triplets
  union all select triplet_id, {_key("j->>'$.subject'")}, {_key("j->>'$.predicate'")}, {_key("coalesce(j->>'$.object', j->>'$.obj')")} from payloads where json_type(j) = 'OBJECT'
  union all select triplet_id, {_key("j->>'$[0]'")}, {_key("j->>'$[1]'")}, {_key("j->>'$[2]'")} from payloads where json_type(j) = 'ARRAY' and json_array_length(j) = 3),
keyed as (select *, min(triplet_id) over (partition by s, p, o) as first_id from facts where s is not null and p is not null and o is not null)"""

_WORDS = lambda c: (
    rf"regexp_extract_all(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace({c}, '([\pL\pN_])-[ \t]*\r?\n\s*([\pL\pN_])', '\1\2', 'g'), "
    r"'<[^<>]{0,200}>|&(nbsp|amp|quot|lt|gt|#[0-9]+);', ' ', 'g'), '[\p{Cf}\p{Mn}]', '', 'g'))), '[\pL\pN]+')"
)
_GRAMS = lambda i, t, c: f"(select {i}, array_to_string(w[k:k+11], ' ') as gram from (select {i}, w, unnest(range(1, len(w) - 10)) as k from (select {i}, {_WORDS(c)} as w from {t} where {c} is not null)))"
_VERBATIM = f"""with i as (select distinct item_id, gram from {_GRAMS("item_id", "eval_items", "text")}), own as (select gram from i group by gram having count(*) = 1)
select distinct doc_id, item_id from {_GRAMS("doc_id", "documents", "text")} d join own using (gram) join i using (gram)"""

ORACLES: dict[str, str] = {
    "p6_verbatim": _VERBATIM,
    "p1_found": f"{_TERMS} select term as predicate_key, mark from marked where mark is not null",
    "p1_predicate_frequencies": f"{_TERMS} select * from marked",
    "p2_found": f"{_FACTS} select first_id, triplet_id as copy_id from keyed where triplet_id <> first_id",
    "p2_distinct_facts": f"{_FACTS} select first_id, count(*) as n_copies, s as subject, p as predicate, o as object from keyed group by first_id, s, p, o",
}
