"""The tables of a data folder as the shapes the operators read, and the same shapes as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.movies import MovieGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted facts as (row_id, subject, predicate, object, source_text, source)."""
    return table(spark, sf_dir, "triplets").select(F.col("triplet_id").alias("row_id"), "subject", "predicate", F.col("obj").alias("object"), "source_text", "source")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "proposals").select(F.col("proposal_id").alias("row_id"), "subject", "predicate", F.col("obj").alias("object"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts made of the trade tables, as (subject, predicate, object, source)."""
    t = lambda name: table(spark, sf_dir, name)
    fact = lambda df, s, p, o, source: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(source).alias("source"))
    nation = t("nation")
    part_name = F.concat(F.lit("Part#"), F.col("p_partkey").cast("string"))
    supplied = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = [
        fact(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "located_in", F.col("n_name"), "customer"),
        fact(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_name"), "located_in", F.col("n_name"), "supplier"),
        fact(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "part_of", F.col("r_name"), "nation"),
        fact(supplied, F.col("s_name"), "supplies", part_name, "lineitem"),
        fact(t("part"), part_name, "has_brand", F.col("p_brand"), "part"),
        fact(t("part"), part_name, "has_type", F.col("p_type"), "part"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def movie_graph(spark: SparkSession, sf_dir: str) -> MovieGraph:
    """Suppliers as persons, parts as movies, line items as edges."""
    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem")
    return MovieGraph(
        person=t("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name")),
        movie=t("part").select(
            F.col("p_partkey").alias("movie_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), (F.col("p_size") + 1990).alias("year"), F.col("p_type").alias("genre")
        ),
        acted_in=items.groupBy(F.col("l_suppkey").alias("person_id"), F.col("l_partkey").alias("movie_id")).agg(F.min("l_returnflag").alias("role")),
        directed=items.groupBy(F.col("l_partkey").alias("movie_id")).agg(F.min("l_suppkey").alias("person_id")),
    )


CREDIT_ORDER = ("movie_title", "person_name", "release_year", "genre", "role")

FACTS_SQL = "facts as (select triplet_id as row_id, subject, predicate, obj as object, source_text, source from triplets)"
PROPOSED_SQL = "proposed as (select proposal_id as row_id, subject, predicate, obj as object from proposals)"
TRADE_SQL = """trade as (
  select c_name as subject, 'located_in' as predicate, n_name as object, 'customer' as source from customer join nation on c_nationkey = n_nationkey
  union all select s_name, 'located_in', n_name, 'supplier' from supplier join nation on s_nationkey = n_nationkey
  union all select n_name, 'part_of', r_name, 'nation' from nation join region on n_regionkey = r_regionkey
  union all select distinct s_name, 'supplies', concat('Part#', p_partkey), 'lineitem' from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  union all select concat('Part#', p_partkey), 'has_brand', p_brand, 'part' from part
  union all select concat('Part#', p_partkey), 'has_type', p_type, 'part' from part)"""
GRAPH_SQL = """person as (select s_suppkey as person_id, s_name as name from supplier),
movie as (select p_partkey as movie_id, concat(p_name, ' ', p_partkey) as title, 1990 + p_size as year, p_type as genre from part),
acted_in as (select l_suppkey as person_id, l_partkey as movie_id, min(l_returnflag) as role from lineitem group by all),
directed as (select min(l_suppkey) as person_id, l_partkey as movie_id from lineitem group by l_partkey)"""
