"""Variant spellings of persons and organisations linked by merging and matching again (problem 5).

Records that surely match are merged; a merged record has all their spellings and initials, so it enters more blocks than its
parts did and may match what none of them matched. This goes on until no merge is left. A spelling that an initial, an acronym or a
lacking word leaves open joins a record only if no other record fits it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import value_key
from factloom.llm.fact_history import left_by_slips, letters, may_agree, signature, slip_pieces
from factloom.llm.names import FUNCTION_WORDS, LEGAL_FORMS, NICKNAMES, ORG_WORDS, given_match, orders, parse, same_org, same_person
from factloom.session import spool

#: A block of more records than this is compared in so many parts, by more than one task.
HOT = 1000
#: Records that one task cuts into blocks.
AT_ONCE = 5_000


@lru_cache(maxsize=100_000)
def _slips(word: str) -> tuple[str, ...]:
    """The word and the word less one letter: two words one slip apart have one of these in common."""
    return (word, *dict.fromkeys(word[:i] + word[i + 1 :] for i in range(len(word)))) if len(word) >= 5 else (word,)


def _initials(given: str) -> set[str]:
    return {given[0], *(f[0] for f in NICKNAMES.get(given, "").split())}


def block_keys(name: str, kind: str | None) -> set[tuple[str, str]]:
    """The blocks of a spelling, as (block, word): a word with the initial of another word, however common the word is.

    Records with the same word share the block of the word itself, whose word is given as empty; those with words one slip apart share
    a block of what a slip leaves, in which only records with different words meet, so that no pair comes once for every slip. The
    latter blocks are not made for every record: which words are one slip apart is found from the distinct words (:func:`_pairs`).
    """
    value = parse(name)
    keys: set[tuple[str, str]] = set()
    if not value.tokens:
        return keys
    if kind != "organisation" and not value.is_org:
        for surname, given in orders(value):
            if not given:
                continue
            for i in _initials(given[0]):
                keys |= {(f"P|{surname}|{i}", "")} | {(f"p|{s}|{i}", surname) for s in _slips(surname)}
            if len(given[0]) > 3:
                keys.add((f"e|{surname}|{given[0][-3:]}", ""))
    if kind != "person" or value.is_org:
        words = [t for t in value.tokens if t not in FUNCTION_WORDS and t not in LEGAL_FORMS]
        stems = [w for w in words if len(w) >= 4 and w not in ORG_WORDS]
        for w in stems:
            for i in {x for o in words if o is not w for x in (o[0], *(o if len(o) <= 4 else ()))}:
                keys |= {(f"O|{w}|{i}", "")} | {(f"o|{s}|{i}", w) for s in _slips(w)}
        if not stems or len(words) == 1:
            keys |= {(f"r|{s}", "") for s in slip_pieces("".join(sorted(words)))}
    return keys


def profile_match(kind_a: str | None, names_a: list[str], kind_b: str | None, names_b: list[str]) -> tuple[int, bool]:
    """How surely two records, each with all its spellings, are one (2 surely, 1 if nothing else fits, 0 not), and whether they
    were compared as organisations."""
    if kind_a and kind_b and kind_a != kind_b:
        return 0, False
    kind = kind_a or kind_b
    va, vb = [parse(n) for n in names_a], [parse(n) for n in names_b]
    org = kind == "organisation" or (kind is None and any(v.is_org for v in va + vb))
    best = 0
    for a in va:
        for b in vb:
            if org:
                level = same_org(a, b)
            else:
                level = 2 if a.key == b.key else same_person(a, b)
            best = max(best, level)
    if best and not org and not _compatible(va, vb):
        return 0, org
    if best == 1 and not org and not (_open(va) or _open(vb)):
        return 0, org
    return best, org


def _full_given(values) -> set[str]:
    return {given[0] for v in values for _, given in orders(v)[:1] if given and len(given[0]) > 1}


def _middle(values) -> set[str]:
    return {given[1] for v in values for _, given in orders(v)[:1] if len(given) > 1}


def _middle_initials(names: list[str]) -> str:
    return "".join(sorted({m[0] for m in _middle([parse(n) for n in names])}))


def _compatible(va, vb) -> bool:
    """No spelling of one record has a middle name that the other's middle names exclude."""
    ma, mb = _middle(va), _middle(vb)
    return not ma or not mb or any(given_match(x, y) for x in ma for y in mb)


def _open(values) -> bool:
    """Whether a record has initials only and no given name."""
    return all(len(given[0]) == 1 for v in values for _, given in orders(v)[:1] if given)


def is_open(names: list[str], org: bool) -> bool:
    """Whether a record's spellings leave open whom they mean: initials only, an acronym, or a name without its kind word."""
    values = [parse(n) for n in names]
    return not any(v.is_org for v in values) if org else _open(values)


def distinct_spellings(entities: DataFrame, id_col: str, name_col: str, kind_col: str | None) -> DataFrame:
    """(``sid``, ``name``, ``kind``): spellings that agree but for formatting are one, combined within each task first."""
    kind = F.col(kind_col) if kind_col else F.lit(None).cast("string")
    rows = entities.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.lower(kind).alias("kind"), value_key(F.col(name_col)).alias("key"))
    return rows.filter("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("sid"), F.min("name").alias("name"), F.max("kind").alias("kind"))


def _pairs(records: DataFrame, only_changed: bool) -> DataFrame:
    """Pairs of records that share a block, once each; after the first round only those with a record that grew.

    Of a block of more than ``HOT`` records one side is dealt out to parts and the other is in all of them, so no task compares all of it.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (_hash(f"{as_what}|{word}"), _hash(context), c, bool(g), alike, as_what == "O", word if as_what in "PO" and len(word) >= 4 else None)
                for c, kind, names, g in zip(b["cid"], b["kind"], b["names"], b["grew"])
                for (as_what, word, context), alike in _posted(names, kind)
            ]
            yield pd.DataFrame(rows, columns=["word", "context", "cid", "grew", "alike", "org", "spelled"]).astype({"word": "int64", "context": "int64", "cid": "int64", "grew": "bool", "alike": "int32", "org": "bool"})

    postings = spool(
        _spread(records.select("cid", "kind", "names", "grew")).mapInPandas(keys, "word long, context long, cid long, grew boolean, alike int, org boolean, spelled string"), "postings"
    )
    # words one slip apart, from the distinct words and not from the records that have them
    words = postings.filter("spelled is not null").select("word", "org", "spelled").distinct()
    left = left_by_slips(words.select(F.struct("word", "org").alias("word"), "spelled")).select(F.xxhash64("left", "word.org").alias("left"), "word.word")
    slips = spool(left.join(left.withColumnRenamed("word", "near"), "left").filter("word <> near").select("word", "near").distinct(), "slips")
    row = lambda word: [F.xxhash64(word, "context").alias("key"), "cid", "grew", "alike"]
    same = postings.select(*row("word"))
    asked = same.unionByName(postings.join(slips, "word").select(*row("near")))
    if only_changed:  # a record that grew asks for all, the others for none
        asked = asked.filter("grew")
    hot = same.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("parts"))
    deal = lambda side: side.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = deal(asked).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("cid").alias("a"), F.col("alike").alias("alike_a"))
    right = deal(same).select("key", F.pmod(F.xxhash64("cid"), "parts").alias("part"), F.col("cid").alias("b"), F.col("grew").alias("gb"), F.col("alike").alias("alike_b"))
    # two that grew, or any two of the first round, ask for each other; one direction is enough
    once = F.col("a") < F.col("b") if not only_changed else (F.col("a") < F.col("b")) | (~F.col("gb") & (F.col("a") > F.col("b")))
    pairs = left.join(right, ["key", "part"]).filter(once & may_agree("alike_a", "alike_b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _posted(names: list[str], kind: str | None) -> set[tuple[tuple[str, str, str], int]]:
    """((what it is found as, word, context), signature) of the blocks of all spellings of a record, but for those of slips."""
    out = set()
    for n in names:
        alike = _signatures(n)
        for block, word in block_keys(n, kind):
            if not word:
                as_what, found_by, context = (block.split("|") + ["", ""])[:3]
                out.update(((as_what, found_by, context), a) for a in alike.get((as_what, found_by, context), {0}))
    return out


def _signatures(name: str) -> dict[tuple[str, str, str], set[int]]:
    """Per block: the letters of the given name, or what the other words of an organisation look like; of three words, both of the others."""
    value = parse(name)
    words = [t for t in value.tokens if t not in FUNCTION_WORDS and t not in LEGAL_FORMS]
    out: dict[tuple[str, str, str], set[int]] = {}
    for surname, given in orders(value):
        for full in {given[0], *NICKNAMES.get(given[0], "").split()} if given else ():
            out.setdefault(("P", surname, full[0]), set()).add(letters(full, 20) if len(full) > 1 else 0)
        if given and len(given[0]) > 3:
            out.setdefault(("e", surname, given[0][-3:]), set()).add(letters(given[0], 20))
    for w in words:
        others = [o for o in words if o is not w]
        for k, o in enumerate(others):
            alike = signature(o, others[1 - k] if len(words) == 3 and len(others) == 2 else "")
            for i in (o[0], *(o if len(o) <= 4 else ())):
                out.setdefault(("O", w, i), set()).add(alike)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _levels(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, level, open_a, open_b) of the pairs that match at all."""

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [profile_match(*row) for row in zip(b["kind_a"], b["names_a"], b["kind_b"], b["names_b"])]
            b = b.assign(level=np.array([f[0] for f in found], dtype=np.int32), org=np.array([f[1] for f in found], dtype=bool))
            b = b[b["level"] > 0]
            yield pd.DataFrame(
                {
                    "a": b["a"], "b": b["b"], "level": b["level"],
                    "open_a": np.array([is_open(n, o) for n, o in zip(b["names_a"], b["org"])], dtype=bool),
                    "open_b": np.array([is_open(n, o) for n, o in zip(b["names_b"], b["org"])], dtype=bool),
                    "middle_a": pd.Series([_middle_initials(n) for n in b["names_a"]], index=b.index, dtype=object),
                    "middle_b": pd.Series([_middle_initials(n) for n in b["names_b"]], index=b.index, dtype=object),
                }
            )

    side = lambda x: records.select(F.col("cid").alias(x), F.col("names").alias(f"names_{x}"), F.col("kind").alias(f"kind_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "kind_a", "names_a", "kind_b", "names_b")
    return joined.mapInPandas(level, "a long, b long, level int, open_a boolean, open_b boolean, middle_a string, middle_b string")


def _sure_edges(levels: DataFrame) -> DataFrame:
    """Edges of level 2, less those of a record without middle name whose partners have different middle names."""
    sure = levels.filter("level = 2")
    both = sure.select("a", "middle_a", "middle_b").unionByName(sure.select(F.col("b").alias("a"), F.col("middle_b").alias("middle_a"), F.col("middle_a").alias("middle_b")))
    torn = both.filter("middle_a = '' and middle_b <> ''").groupBy("a").agg(F.count_distinct("middle_b").alias("n")).filter("n > 1").select(F.col("a").alias("torn"))
    kept = sure.join(torn, (sure["a"] == torn["torn"]) & (sure["middle_b"] != ""), "left_anti")
    kept = kept.join(torn, (kept["b"] == torn["torn"]) & (kept["middle_a"] != ""), "left_anti")
    return kept.select("a", "b")


def _only_edges(levels: DataFrame) -> DataFrame:
    """Edges of level 1 whose open side fits one settled record and no other (or, if none is settled, one open one)."""
    weak = levels.filter("level >= 1")
    both = weak.select("a", "b", "open_a", "open_b").unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("open_b").alias("open_a"), F.col("open_a").alias("open_b")))
    per = both.filter("open_a").groupBy("a").agg(
        F.count_if(~F.col("open_b")).alias("settled"), F.count_if(F.col("open_b")).alias("open"), F.min(F.when(~F.col("open_b"), F.col("b"))).alias("to"), F.min(F.when(F.col("open_b"), F.col("b"))).alias("to_open")
    )
    chosen = per.select("a", F.when(F.col("settled") == 1, F.col("to")).when((F.col("settled") == 0) & (F.col("open") == 1), F.col("to_open")).alias("b")).filter("b is not null")
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) with the smallest node of each connected component, for all nodes with an edge.

    Every round each node takes the smallest root among itself and its neighbours, and that root's root; rounds are written to
    the shared folder, so lineage stays short. Only the number of changes reaches the driver.
    """
    edges = spool(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = spool(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        jumped = stepped.join(jump, "next", "left").select("node", "root", F.coalesce(F.least("next", "far"), "next").alias("next"))
        fresh = spool(jumped, "labels")
        if fresh.filter("root <> next").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", F.col("next").alias("root"))


def _spread(records: DataFrame) -> DataFrame:
    """Records in as many tasks as their number asks for: blocking works much longer on a record than its bytes say."""
    return records.repartition(max(8, -(-records.count() // AT_ONCE)), "cid")


def _merge(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Records united under the smallest id of their component: all spellings together."""
    moved = records.join(roots, records["cid"] == roots["node"], "left").select(F.coalesce("root", "cid").alias("cid"), "names", "kind", F.col("root").isNotNull().alias("grew"))
    return moved.groupBy("cid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.max("kind").alias("kind"), F.max("grew").alias("grew"))


def link_entities(entities: DataFrame, id_col: str = "entity_id", name_col: str = "name", kind_col: str | None = "kind") -> DataFrame:
    """(``id_col``, ``cluster_id``): every entity row with the smallest id of the rows that name the same entity.

    Spellings that differ in formatting only are one from the start, however many rows have them. Records of different kinds never
    meet; a null kind fits both. Null names and names without a letter or digit form a cluster of their own row. Repeated rows share
    a cluster; ids are unique, and rows with a null id are left out. An empty table gives no rows.
    """
    spellings = spool(distinct_spellings(entities, id_col, name_col, kind_col), "spellings")
    records = spellings.select(F.col("sid").alias("cid"), F.array("name").alias("names"), "kind", F.lit(True).alias("grew"))
    records = spool(records, "records")
    levels, merged, sure_left = None, None, True
    while True:  # every round merges a pair or is the last
        if levels is None:
            levels = spool(_levels(_pairs(records, only_changed=False), records), "levels")
        elif merged is not None:
            # what two records that did not grow are to each other is known; only pairs with one that grew are matched again
            kept = levels.join(merged.select(F.col("node").alias("a")), "a", "left_anti").join(merged.select(F.col("node").alias("b")), "b", "left_anti").select(*levels.columns)
            levels = spool(kept.unionByName(_levels(_pairs(records, only_changed=True), records)), "levels")
        edges = _sure_edges(levels) if sure_left else _sure_edges(levels).unionByName(_only_edges(levels)).distinct()
        edges = spool(edges, "merges")
        if edges.isEmpty():
            if not sure_left:
                break
            sure_left, merged = False, None
            continue
        merged = components(edges)
        records = spool(_merge(records, merged), "records")
        sure_left = True
    parts = records.select(F.col("cid").alias("cluster_id"), F.explode("names").alias("name"))
    of_spelling = spellings.select("sid", "key", "name").join(parts, "name").groupBy("key").agg(F.min("cluster_id").alias("cluster_id"))
    rows = entities.select(F.col(id_col), value_key(F.col(name_col)).alias("key")).filter(F.col(id_col).isNotNull())
    return rows.join(of_spelling, "key", "left").select(id_col, F.coalesce("cluster_id", F.col(id_col).cast("long")).alias("cluster_id"))


def linked_pairs(clusters: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """All pairs (``{id}_a`` < ``{id}_b``) of rows in one cluster, from the cluster ids."""
    left = clusters.select("cluster_id", F.col(id_col).alias(f"{id_col}_a"))
    right = clusters.select("cluster_id", F.col(id_col).alias(f"{id_col}_b"))
    return left.join(right, "cluster_id").filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")
