import random

import numpy as np
import pytest

from factloom.operators import graph, movies, vector
from factloom.plans.core_queries import QUERIES

SCHEMA = "row_id long, subject string, predicate string, object string, source string"


def facts(spark, *rows):
    return spark.createDataFrame([(k, *r, "s") for k, r in enumerate(rows)], SCHEMA)


CHAIN = [("A", "p", "b"), ("B", "q", "c"), ("c", "r", "D"), ("x", "p", "y"), ("b", "s", "b")]


def test_expand_grows_with_depth(spark):
    df = facts(spark, *CHAIN)
    sizes = [graph.expand(df, "a", d, None).count() for d in (1, 2, 3, 4, 5)]
    assert sizes == [1, 3, 4, 4, 4]
    hops = {r.predicate: r.hop for r in graph.expand(df, "a", 3, None).collect()}
    assert hops == {"p": 1, "q": 2, "s": 2, "r": 3}
    assert [r.predicate for r in graph.expand(df, "a", 3, 2).collect()] == ["p", "q"]
    assert graph.expand(df, "a", 2, None, repeats=True).count() > 3
    assert graph.expand(df, "nobody").count() == 0


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y"), (None, "a")], "src string, dst string")
    assert tuple(graph.shortest_path(edges, "a", "c").first()) == (2, ["a", "b", "c"])
    assert graph.shortest_path(edges, "a", "x").count() == 0
    assert graph.shortest_path(edges, "a", "a").first().length == 0


def test_pairs_and_labels(spark):
    df = facts(spark, ("a", "p", "b"), ("a", "q", "b"), ("a", "p", "b"), ("b", "x" * 30, "a"), (None, "p", "b"))
    got = {(r.subject, r.object): (r.predicates, r.label) for r in graph.pair_edges(df).withColumn("label", graph.edge_label("predicates")).collect()}
    assert got == {("a", "b"): (["p", "q"], "p, q"), ("b", "a"): (["x" * 30], "x" * 17 + "...")}


def test_degrees(spark):
    df = facts(spark, ("a", "p", "b"), ("a", "q", "b"), ("a", "p", "a"))
    degree = graph.degrees(df)
    assert {r.node: r.degree for r in degree.collect()} == {"a": 3, "b": 1}
    got = {r.node: (r.norm, r.size, r.centrality) for r in graph.scaled_degrees(degree).collect()}
    assert got == {"a": (1.0, 1200.0, 3.0), "b": (0.0, 600.0, 1.0)}
    many = facts(spark, *[("hub", "p", f"n{k:02d}") for k in range(40)])
    assert [r.node for r in graph.labelled_nodes(graph.degrees(many)).collect() if r.node == "hub"] == ["hub"]


def test_components_like_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    parent = {n: n for p in pairs for n in p}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "subject string, object string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_average_length(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c")], "subject string, object string")
    assert graph.average_path_length(line).first()[0] == pytest.approx(4 / 3)
    split = spark.createDataFrame([("a", "b"), ("c", "d")], "subject string, object string")
    assert graph.average_path_length(split).first()[0] is None
    # more nodes than a block has are done in blocks, with the same result
    assert graph.average_path_length(line, block=1).first()[0] == pytest.approx(4 / 3)


def test_long_paths_are_found(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(18)], "src string, dst string")
    row = graph.shortest_path(chain, "n0", "n18").first()
    assert row.length == 18 and row.path == [f"n{k}" for k in range(19)]
    assert graph.shortest_path(chain, "n0", "n18", max_depth=17).count() == 0 and graph.shortest_path(chain, "n0", "nowhere").count() == 0


def test_vectors_like_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 8))
    m[5] = 0
    items = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = items.filter("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    m32 = m.astype(np.float32).astype(np.float64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector.top_k(queries, items, 3).collect()}
    for q in range(4):
        scores = np.round(m32 @ m32[q], 6)
        order = sorted(range(40), key=lambda i: (-scores[i], i))[:3]
        assert [got[q, r][0] for r in range(3)] == order
    cos = vector.top_k(items.filter("vec_id = 5").withColumnRenamed("vec_id", "query_id"), items, 1, measure="cosine").first()
    assert cos.score == 0.0 and cos.vec_id == 0
    assert [r.vec_id for r in vector.search_one(items, m32[1].tolist(), 2).collect()] == [got[1, 0][0], got[1, 1][0]]
    assert vector.top_k(queries.limit(0), items, 3).count() == 0
    with pytest.raises(ValueError):
        vector.top_k(queries, items, 1, measure="ivf")


def test_mean_vectors(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    texts = spark.createDataFrame([(1, "A b"), (2, "zzz"), (3, None)], "i int, t string")
    assert {r.i: r.vector for r in vector.mean_vectors(texts, words, "i", "t", 2).collect()} == {1: [0.5, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_credits_import(spark):
    rows = [(1, "P", "M", 2000, "drama", "lead"), (2, "P", "M", 2001, None, None), (3, None, "M", 1, "x", "y"), (4, "Q", None, 1, "x", "y")]
    g = movies.import_credits(spark.createDataFrame(rows, "row_id long, person_name string, movie_title string, release_year int, genre string, role string"), "row_id")
    assert [tuple(r) for r in g.movie.select("title", "year", "genre").collect()] == [("M", 2000, "drama")]
    assert [tuple(r) for r in g.acted_in.collect()] == [("P", "M", None)]
    assert sorted(r.name for r in g.person.collect()) == ["P", "Q"]
    assert movies.count_movies(g, "nobody").first()[0] == 0
    assert movies.coactors(g, "P").count() == 0


def test_registered_components_like_union_find(spark, tmp_path):
    rng = random.Random(12)
    lines = [(rng.randrange(60), rng.randrange(80)) for _ in range(70)]
    triplets = [(k, f"s{rng.randrange(40)}", "p", f"s{rng.randrange(40)}", "t", "x") for k in range(25)] + [(90, None, "p", "s1", "t", "x")]
    frames = {
        "supplier": spark.createDataFrame([(k, f"S{k}") for k in range(60)], "s_suppkey long, s_name string"),
        "part": spark.createDataFrame([(k, f"P{k}", 3, "t") for k in range(80)], "p_partkey long, p_name string, p_size int, p_type string"),
        "lineitem": spark.createDataFrame([(s, p, "N") for s, p in lines], "l_suppkey long, l_partkey long, l_returnflag string"),
        "triplets": spark.createDataFrame(triplets, "triplet_id long, subject string, predicate string, obj string, source_text string, source string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")

    def smallest(pairs):
        root = {n: n for p in pairs for n in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    got = {r.node: r.component for r in QUERIES["movie_graph_components"](spark, str(tmp_path)).collect()}
    assert got == smallest([(str(s), f"m{p}") for s, p in lines])
    report = {r.measure: r.value for r in QUERIES["graph_measures_whole"](spark, str(tmp_path)).collect()}
    assert report["components"] == len(set(smallest([(t[1], t[3]) for t in triplets if t[1]]).values())) and len(report) == 4
