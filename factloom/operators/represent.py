"""Facts as text: normalised parts, embeddable texts, context blocks and result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import humanize

PARTS = ("subject", "predicate", "object")
MODES = ("triplet_text", "entity_context")
NO_FACTS = "No relevant facts found."


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def normalize(facts: DataFrame) -> DataFrame:
    """Underscores of subject, predicate and object become spaces; case and other columns stay."""
    return facts.withColumns({p: humanize(F.col(p)) for p in PARTS})


def fact_string() -> Column:
    """``(s, p, o)`` as written; null parts are empty."""
    return F.concat(F.lit("("), _filled("subject"), F.lit(", "), _filled("predicate"), F.lit(", "), _filled("object"), F.lit(")"))


def fact_text(facts: DataFrame) -> DataFrame:
    """``text`` (humanised parts joined by spaces) and ``document`` (the fact string as written) beside every fact."""
    text = F.concat(humanize(_filled("subject")), F.lit(" "), humanize(_filled("predicate")), F.lit(" "), humanize(_filled("object")))
    return facts.withColumns({"text": text, "document": fact_string()})


def entity_context(facts: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per subject, compared exactly: its facts in the order of ``order`` as ``text``, their number and the facts.

    The whole context of a subject is one row, so one task holds it; :func:`entity_parts` deals it out where a subject may have
    very many facts. Null subjects form no entity.
    """
    rows = facts.filter(F.col("subject").isNotNull())
    fact = F.struct(F.col(order).alias("order"), F.concat(humanize(_filled("predicate")), F.lit(": "), humanize(_filled("object"))).alias("fact"), fact_string().alias("document"))
    grouped = rows.groupBy(F.col("subject").alias("entity")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    return grouped.select(
        "entity",
        F.concat(humanize(F.col("entity")), F.lit(": "), F.array_join(F.transform("facts", lambda f: f["fact"]), ", ")).alias("text"),
        F.size("facts").alias("fact_count"),
        F.transform("facts", lambda f: f["document"]).alias("triplets"),
    )


def entity_parts(facts: DataFrame, order: str = "row_id", most: int = 1_000) -> DataFrame:
    """(``part_id``, ``entity``, ``part``, ``text``, ``fact_count``, ``facts``): every subject's facts in parts of about ``most``.

    A subject of up to ``most`` facts is one part and reads like :func:`entity_context`. The facts of a larger one are dealt out to
    parts by a hash of their place, so no task holds all of them; within a part they are in the order of ``order``. No fact is lost.
    """
    rows = facts.filter(F.col("subject").isNotNull())
    sizes = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("subject", F.ceil(F.col("n") / most).alias("__parts"))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(order), F.col("__parts"))).cast("long")
    fact = F.struct(F.col(order).alias("order"), "subject", "predicate", "object")
    dealt = rows.join(sizes, "subject", "left").groupBy(F.col("subject").alias("entity"), part.alias("part")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    said = F.transform("facts", lambda f: F.concat(humanize(F.coalesce(f["predicate"], F.lit(""))), F.lit(": "), humanize(F.coalesce(f["object"], F.lit("")))))
    text = F.concat(humanize(F.col("entity")), F.lit(": "), F.array_join(said, ", "))
    return dealt.select(F.concat("entity", F.lit("#"), F.col("part").cast("string")).alias("part_id"), "entity", "part", text.alias("text"), F.size("facts").alias("fact_count"), "facts")


def represent(facts: DataFrame, mode: str = "triplet_text", order: str = "row_id") -> DataFrame:
    """Embeddable texts of the facts in a mode of :data:`MODES`."""
    if mode == "triplet_text":
        return fact_text(facts)
    if mode == "entity_context":
        return entity_context(facts, order)
    raise ValueError(f"unknown representation mode {mode!r}; known are {', '.join(MODES)}")


def fact_lines(style: str) -> Column:
    """A retrieved fact as a line: ``list``, ``natural``, ``table`` (needs ``score``) or ``scored``."""
    s, p, o = (humanize(_filled(x)) for x in PARTS)
    if style == "list":
        return F.concat(F.lit("("), s, F.lit(", "), p, F.lit(", "), o, F.lit(")"))
    if style == "natural":
        return F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit("."))
    if style == "table":
        return F.format_string("| %s | %s | %s | %.3f |", s, p, o, F.col("score").cast("double"))
    if style == "scored":
        return F.format_string("[%.2f] (%s, %s, %s)", F.col("score").cast("double"), s, p, o)
    raise ValueError(f"unknown format {style!r}; known are list, natural, table, scored")


def format_results(results: DataFrame, style: str = "list", query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, ``context``): the facts of every query in the order of rank as one text."""
    line = F.struct(F.col(rank).alias("rank"), fact_lines(style).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    head = "| Subject | Predicate | Object | Score |\n|---|---|---|---|\n" if style == "table" else ""
    return results.groupBy(query).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("context"))


def with_empty_context(queries: DataFrame, contexts: DataFrame, query: str = "query_id") -> DataFrame:
    """Every query with its context; queries without facts get the fixed sentence."""
    return queries.select(query).join(contexts, query, "left").select(query, F.coalesce("context", F.lit(NO_FACTS)).alias("context"))
