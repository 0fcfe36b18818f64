"""Mixing sources to target shares of the total size in tokens (problem 7).

Sizes are tokens of a public tokenizer. Every document of a source gets its expected number of copies from its weight; the whole
copies are certain, the rest is drawn by Pareto order sampling: documents are ranked by random odds divided by inclusion odds, and
the lowest ranks are taken until the source's tokens are filled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.session import spool

#: Folder of public tokenizer files; the file is a parameter of :func:`count_tokens`.
TOKENIZERS = "/opt/tokenizers"
#: Sources with a target are a parameter table; more than this is refused, since it is broadcast.
MAX_SOURCES = 10_000
#: Largest weight of a document; weights are whole numbers, so the sizes per source and weight stay a small table.
MAX_WEIGHT = 64
#: Ranks are first cut into so many bins per source; only the bin that holds the border is sorted.
BINS = 65_536


@lru_cache(maxsize=4)
def _encoder(file: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(file).read_bytes().splitlines() if line)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding(Path(file).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Long texts are encoded in pieces of about this many characters, which keeps what the encoder holds small.
_PIECE = 100_000
#: A blank between two letters or digits: the encoder's pattern always begins a new piece there, so a cut changes no token.
_BLANK = re.compile(r"(?<=\w) (?=\w)")


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        blank = _BLANK.search(text, start + _PIECE)
        end = blank.start() if blank else len(text)
        yield text[start:end]
        start = end


def token_count(text: str | None, file: str) -> int:
    """Tokens of a whole text; a null text has none."""
    if not text:
        return 0
    encode = _encoder(file).encode_ordinary
    return sum(len(encode(piece)) for piece in _pieces(text))


def count_tokens(docs: DataFrame, columns: list[str], text: str = "text", file: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The named columns and ``tokens``, the length of the whole text in tokens of a public tokenizer.

    ``file`` is the tokenizer's vocabulary on the driver; Spark sends it to the executors.
    """
    kept = docs.select(*columns, F.col(text).alias("__text"))
    docs.sparkSession.sparkContext.addFile(file)
    name = Path(file).name

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sent = SparkFiles.get(name)
        for texts in batches:
            yield texts.map(lambda t: token_count(t, sent)).astype("int64")

    return kept.select(*columns, F.pandas_udf(count, "long")("__text").alias("tokens"))


def _uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the document's id and the seed only, so a lost executor changes nothing."""
    return (F.xxhash64(id_col, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens_col: str = "tokens", weight_col: str | None = None, total_tokens: int | None = None, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """Choose copies of documents so that each source has its target share of all tokens.

    ``docs`` has an id, a source, its tokens and, if ``weight_col`` is named, a whole weight from 1 to 64 (null and
    less are 1, more is an error). ``targets`` has ``source``, ``target_share`` and ``max_repeats``. Returns

    * ``chosen``: (``id``, ``source``, ``tokens``, ``copies``), the documents used, ``copies`` between 1 and ``max_repeats``;
    * ``report``: one row per source of ``targets``: ``target_share``, ``wanted_tokens``, ``capacity_tokens``, ``chosen_tokens``,
      ``chosen_docs``, ``copies`` and ``actual_share`` of all chosen tokens.

    Without ``total_tokens`` the total is the largest for which every source that has documents can fill its share: shares of
    sources without documents go to the others in proportion. With it, a source that cannot fill its share contributes all its
    copies, and the report shows the gap. The expected copies of a document are in proportion to its weight, at most
    ``max_repeats``; sizes deviate from the wanted ones by half a document at most. Documents without a source, without a target or
    without tokens are not used. A source repeated in ``targets`` counts once, with its largest share. Ties in rank are broken by id.
    """
    spark = docs.sparkSession
    plan = _targets(targets)
    weight = F.lit(1) if weight_col is None else _checked_weight(F.col(weight_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(tokens_col).cast("long").alias("tokens"), weight.cast("int").alias("weight")
    ).filter("tokens > 0 and source is not null")
    rows = rows.join(F.broadcast(spark.createDataFrame([(s,) for s in plan], "source string")), "source", "left_semi")
    rows = spool(rows, "sized")  # read three times below; token counts are made once
    # at most sources x 64 rows reach the driver, whatever the number of documents
    sizes: dict[str, dict[int, int]] = {s: {} for s in plan}
    for source, w, tokens in rows.groupBy("source", "weight").agg(F.sum("tokens")).collect():
        sizes[source][w] = tokens
    wanted = _wanted(plan, sizes, total_tokens)
    rates = [(s, w, c) for s in plan for w, c in _expected_copies(sizes[s], plan[s][1], wanted[s]).items()]
    rated = rows.join(F.broadcast(spark.createDataFrame(rates, "source string, weight int, expected double")), ["source", "weight"])
    whole = F.floor("expected").cast("int")
    share = F.col("expected") - whole
    u = _uniform(F.col("id"), seed)
    rank = F.when(share > 0, (u / (1 - u)) / (share / (1 - share)))
    ranked = rated.select("id", "source", "tokens", whole.alias("whole"), rank.alias("rank"))
    drawn = _fill(ranked, wanted)
    chosen = drawn.filter("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.count(F.lit(1)).alias("chosen_docs"), F.sum("copies").alias("copies"))
    base = spark.createDataFrame(
        [(s, share_, repeats, int(wanted[s]), sum(sizes[s].values()) * repeats) for s, (share_, repeats) in plan.items()],
        "source string, target_share double, max_repeats int, wanted_tokens long, capacity_tokens long",
    )
    joined = base.join(used, "source", "left").na.fill(0, ["chosen_tokens", "chosen_docs", "copies"])
    all_tokens = F.sum("chosen_tokens").over(Window.partitionBy())
    report = joined.withColumn("actual_share", F.when(all_tokens > 0, F.col("chosen_tokens") / all_tokens).otherwise(F.lit(0.0)))
    return chosen, report


def _checked_weight(weight: Column) -> Column:
    """Null and less than 1 count as 1; more than ``MAX_WEIGHT`` is an error."""
    tooheavy = F.raise_error(F.concat(F.lit(f"a weight may be {MAX_WEIGHT} at most, not "), weight.cast("string")))
    return F.when(weight > MAX_WEIGHT, tooheavy.cast("int")).otherwise(F.greatest(F.lit(1), F.coalesce(weight, F.lit(1))))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {s: (float(share or 0.0), max(1, int(repeats or 1))) for s, share, repeats in rows}


def _wanted(plan: dict[str, tuple[float, int]], sizes: dict[str, dict[int, int]], total: int | None) -> dict[str, float]:
    capacity = {s: sum(sizes[s].values()) * plan[s][1] for s in plan}
    able = {s: share for s, (share, _) in plan.items() if share > 0 and capacity[s] > 0}
    if not able:
        return dict.fromkeys(plan, 0.0)
    scale = sum(able.values())
    if total is None:
        total = min(capacity[s] * scale / share for s, share in able.items())
    return {s: min(capacity[s], total * able[s] / scale) if s in able else 0.0 for s in plan}


def _expected_copies(sizes: dict[int, int], repeats: int, wanted: float) -> dict[int, float]:
    """Copies per weight, in proportion to it and at most ``repeats``, that make up the wanted tokens (water filling)."""
    open_, copies, left = dict(sizes), {}, wanted
    while open_:
        mass = sum(w * n for w, n in open_.items())
        factor = left / mass if mass else 0.0
        full = [w for w in open_ if factor * w >= repeats]
        if not full:
            return copies | {w: max(0.0, factor * w) for w in open_}
        for w in full:
            copies[w] = float(repeats)
            left -= repeats * open_.pop(w)
    return copies


def _fill(ranked: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Take the lowest ranks of each source until its tokens are filled.

    Ranks fall into bins; bin sizes are summed (at most sources x 65,536 small rows), a running sum finds the bin that holds the
    border, and only that bin's documents are sorted. A source with a third of all documents has bins of 1/65,536 of that.
    """
    spark = ranked.sparkSession
    goals = F.broadcast(spark.createDataFrame([(s, float(g)) for s, g in wanted.items()], "source string, goal double"))
    # odds are mapped to (0, 1) before they are cut, so bins are about equally full
    bin_ = F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")
    binned = spool(ranked.withColumn("bin", bin_), "ranks")
    per_bin = binned.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("tokens"))).alias("extra"), F.sum(F.col("tokens") * F.col("whole")).alias("certain"))
    certain = per_bin.groupBy("source").agg(F.sum("certain").alias("certain"))
    running = F.sum("extra").over(Window.partitionBy("source").orderBy("bin"))
    filled = per_bin.filter("bin is not null").select("source", "bin", "extra", running.alias("upto"))
    filled = filled.join(F.broadcast(certain), "source").join(goals, "source").withColumn("need", F.col("goal") - F.col("certain"))
    border = filled.filter("upto > need").groupBy("source").agg(F.min(F.struct("bin", (F.col("need") - (F.col("upto") - F.col("extra"))).alias("left"))).alias("b")).select("source", F.col("b.bin").alias("border"), F.col("b.left").alias("left"))
    placed = binned.join(F.broadcast(border), "source", "left")
    inside = placed.filter("bin = border")
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "id"))
    # a document is taken if at least half of it lies before the border, so the size is off by half a document at most
    inside = inside.withColumn("extra", (so_far - F.col("tokens") / 2 <= F.col("left")).cast("int"))
    outside = placed.filter("bin is null or border is null or bin <> border").withColumn("extra", F.when(F.col("bin").isNull(), 0).when(F.col("border").isNull() | (F.col("bin") < F.col("border")), 1).otherwise(0))
    return outside.unionByName(inside).select("id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies"))


def length_weight(tokens: Column) -> Column:
    """A weight that grows by one each time a document's tokens double: fragments are drawn less often than full texts."""
    return F.least(F.lit(MAX_WEIGHT), F.greatest(F.lit(1), F.floor(F.log2(tokens + F.lit(1))))).cast("int")
