"""Graph operators over facts: expansion, paths, degrees, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.session import drop_spooled, spool

PARTS = ("subject", "predicate", "object")
MAX_DEPTH = 50


def _ends(facts: DataFrame) -> DataFrame:
    """(``end``, ``next``) for both directions of every fact, lower case; parallel facts repeat, so that nothing is shuffled here."""
    s, o = F.lower("subject"), F.lower("object")
    return facts.select(s.alias("end"), o.alias("next")).unionByName(facts.select(o.alias("end"), s.alias("next"))).filter("end is not null and next is not null")


def expand(facts: DataFrame, entity: str, depth: int = 2, limit: int | None = 100, repeats: bool = False) -> DataFrame:
    """Facts within ``depth`` hops of an entity, case ignored, with ``hop``, ordered by hop and parts, the first ``limit``.

    Each fact comes once with the first hop that reaches it; ``repeats`` returns it for every hop whose frontier touches it.
    The frontier meets subjects and objects in two equi-joins, and only what it reaches is made distinct. Depths up to 3 unroll into
    one plan; deeper ones write the frontier of each hop to the shared folder.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    spark = facts.sparkSession
    adjacent = _ends(facts)
    reached = spark.createDataFrame([(entity.lower(), 0)], "end string, hop int")
    frontier = reached
    for hop in range(1, depth):
        step = frontier.select("end").join(adjacent, "end").select(F.col("next").alias("end")).distinct()
        frontier = step.join(reached.select("end"), "end", "left_anti").withColumn("hop", F.lit(hop))
        if depth > 3:
            frontier = spool(frontier, "frontier")
            if frontier.isEmpty():
                break
        reached = reached.unionByName(frontier)
    a = reached.select(F.col("end").alias("__s"), F.col("hop").alias("__hs"))
    b = reached.select(F.col("end").alias("__o"), F.col("hop").alias("__ho"))
    from_subject = facts.join(a, F.lower("subject") == F.col("__s")).select(*facts.columns, (F.col("__hs") + 1).alias("hop"))
    from_object = facts.join(b, F.lower("object") == F.col("__o")).select(*facts.columns, (F.col("__ho") + 1).alias("hop"))
    touched = from_subject.unionByName(from_object)
    if repeats:
        hits = touched.distinct()
    else:
        hits = touched.groupBy(*[c for c in facts.columns]).agg(F.min("hop").alias("hop"))
    return hits if limit is None else hits.orderBy("hop", *PARTS).limit(limit)


def unique_entities(facts: DataFrame) -> DataFrame:
    """All subjects and objects of facts, once each."""
    return facts.select(F.col("subject").alias("entity")).unionByName(facts.select(F.col("object").alias("entity"))).filter("entity is not null").distinct()


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int | None = None) -> DataFrame:
    """One row (``length``, ``path``): the shortest undirected path between two nodes over any edge (``src``, ``dst``).

    Breadth first, level by level, until the goal or the end of its component is reached; each node keeps its smallest parent, so the
    path is deterministic. Levels are written to the shared folder; only whether the goal is reached comes to the driver. No row if
    there is no path, or none within ``max_depth`` where one is given; the path from a node to itself has length 0.
    """
    spark: SparkSession = edges.sparkSession
    both = spool(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src is not null and dst is not null").distinct(), "adjacency")
    level = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    if start == goal:
        known = both.filter(F.col("src") == start).limit(1)
        return known.select(F.lit(0).alias("length"), F.array(F.lit(start)).alias("path"))
    seen, depth = level.select("node"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(both, level["node"] == both["src"]).select(F.col("dst").alias("node"), "path")
        step = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        level = spool(step.select("node", F.concat("path", F.array("node")).alias("path")), "level")
        hit = level.filter(F.col("node") == goal)
        if not hit.isEmpty():
            return hit.select(F.lit(depth).alias("length"), "path")
        if level.isEmpty():
            break
        seen = spool(seen.unionByName(level.select("node")), "seen")
    return spark.createDataFrame([], "length int, path array<string>")


def pair_edges(facts: DataFrame, order: str = "row_id") -> DataFrame:
    """Parallel edges as one: (subject, object) with the distinct predicates in the order of first sight and the first source."""
    rows = facts.filter("subject is not null and object is not null")
    first = rows.groupBy("subject", "object", "predicate").agg(F.min(F.struct(F.col(order).alias("o"), "source")).alias("f"))
    grouped = first.groupBy("subject", "object").agg(F.array_sort(F.collect_list(F.struct(F.col("f.o").alias("o"), "predicate"))).alias("p"), F.min("f").alias("f"))
    return grouped.select("subject", "object", F.transform("p", lambda x: x["predicate"]).alias("predicates"), F.col("f.source").alias("source"))


def edge_label(predicates: Column, keep: int = 20) -> Column:
    """Predicates joined by commas, cut to ``keep`` characters with three dots."""
    text = F.array_join(predicates, ", ")
    return F.when(F.length(text) > keep, F.concat(F.substring(text, 1, keep - 3), F.lit("..."))).otherwise(text)


def degrees(edges: DataFrame, src: str = "subject", dst: str = "object") -> DataFrame:
    """(``node``, ``degree``): in plus out over distinct pairs; a loop counts twice."""
    pairs = edges.select(src, dst).filter(f"{src} is not null and {dst} is not null").distinct()
    ends = pairs.select(F.col(src).alias("node")).unionByName(pairs.select(F.col(dst).alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def scaled_degrees(degree: DataFrame, base: float = 300.0) -> DataFrame:
    """Degrees with ``norm`` ((d - min)/(max - min), 0.5 if all are equal), ``size`` and ``centrality`` (d/(n - 1))."""
    bounds = degree.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.count(F.lit(1)).alias("nodes"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.5))
    size = F.lit(base) + F.col("degree") / F.col("hi") * F.lit(base) * 3
    centrality = F.when(F.col("nodes") > 1, F.col("degree") / (F.col("nodes") - 1)).otherwise(F.lit(1.0))
    return degree.crossJoin(F.broadcast(bounds)).select("node", "degree", norm.alias("norm"), size.alias("size"), centrality.alias("centrality"))


def labelled_nodes(degree: DataFrame, few: int = 30, keep: int = 15) -> DataFrame:
    """(``node``, ``label``) of the nodes worth a label: all of up to ``few``, else those at or above the upper median degree.

    The median is found by a running sum over the counts per degree, of which there are at most about the root of twice the edges.
    """
    per = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    running = per.select("degree", F.sum("n").over(Window.orderBy("degree")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("nodes"))
    cut = running.filter(F.col("upto") > F.floor(F.col("nodes") / 2)).agg(F.min("degree").alias("median"), F.first("nodes").alias("nodes"))
    label = F.when(F.length("node") > keep, F.concat(F.substring("node", 1, keep), F.lit("..."))).otherwise(F.col("node"))
    return degree.crossJoin(F.broadcast(cut)).filter((F.col("nodes") <= few) | (F.col("degree") >= F.col("median"))).select("node", label.alias("label"))


def components(edges: DataFrame, src: str = "subject", dst: str = "object") -> DataFrame:
    """(``node``, ``component``): the smallest node of each connected component.

    Nodes take the smallest label around them and then that label's own label, so rounds grow with the logarithm of the longest
    chain. Each round is written to the shared folder; the driver sees only whether a label changed.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    both = spool(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = spool(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        fresh = spool(stepped.join(far, "next", "left").select("node", "component", F.coalesce(F.least("next", "far"), "next").alias("next")), "labels")
        if fresh.filter("component <> next").isEmpty():
            drop_spooled(both)
            return fresh.select("node", "component")
        drop_spooled(labels)
        labels = fresh.select("node", F.col("next").alias("component"))


def average_path_length(edges: DataFrame, src: str = "subject", dst: str = "object", block: int = 2_000) -> DataFrame:
    """One row: the mean shortest distance over all ordered pairs of a connected graph; null if it is not connected.

    Breadth first from about ``block`` sources at once, level by level, so what is held at a time is at most ``block`` times the
    nodes; only the number of pairs of each level reaches the driver. The result is exact, the work grows with the square of the nodes.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    both = spool(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "pairs")
    nodes = both.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    blocks = -(-n // block)
    total = steps = 0
    for k in range(blocks):
        level = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select(F.col("node").alias("from"), F.col("node").alias("to"))
        seen, distance = level, 0
        while True:
            distance += 1
            step = level.join(both, level["to"] == both["a"]).select("from", F.col("b").alias("to")).distinct()
            level = spool(step.join(seen, ["from", "to"], "left_anti"), "level")
            found = level.count()
            if not found:
                break
            total, steps = total + found, steps + distance * found
            seen = seen.unionByName(level)
    mean = steps / total if n > 1 and total == n * (n - 1) else None
    return edges.sparkSession.createDataFrame([(mean,)], "average_length double")


def graph_report(facts: DataFrame) -> DataFrame:
    """(``measure``, ``value``): nodes, edges (distinct pairs), facts and components."""
    rows = facts.filter("subject is not null and object is not null")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("measure"), "value")
    out = one("nodes", unique_entities(rows)).unionByName(one("edges", rows.select("subject", "object").distinct())).unionByName(one("facts", rows))
    return out.unionByName(one("components", components(rows).select("component").distinct()))
