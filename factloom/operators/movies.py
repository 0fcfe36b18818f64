"""A property graph of persons, movies and genres, and the relational meaning of questions about it.

A graph is a set of tables: ``person`` (person_id, name), ``movie`` (movie_id, title, year, genre), ``acted_in`` (person_id,
movie_id, role) and ``directed`` (person_id, movie_id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.graph import shortest_path


@dataclass(frozen=True)
class MovieGraph:
    person: DataFrame
    movie: DataFrame
    acted_in: DataFrame
    directed: DataFrame


def import_credits(credits: DataFrame, order: str) -> MovieGraph:
    """Vertices and edges of rows of a credits table in the order of ``order``.

    A movie's year and genre come from its first row, an edge's role from its last; nulls of those rows stay. Names and titles are
    the keys; rows without them make no vertex or edge.
    """
    person = credits.select(F.col("person_name").alias("name")).filter("name is not null").distinct().select(F.col("name").alias("person_id"), "name")
    movie = (
        credits.filter("movie_title is not null")
        .groupBy(F.col("movie_title").alias("title"))
        .agg(F.min_by(F.struct(F.col("release_year").alias("year"), "genre"), F.col(order)).alias("m"))
        .select(F.col("title").alias("movie_id"), "title", "m.year", "m.genre")
    )
    acted = (
        credits.filter("person_name is not null and movie_title is not null")
        .groupBy(F.col("person_name").alias("person_id"), F.col("movie_title").alias("movie_id"))
        .agg(F.max_by(F.struct("role"), F.col(order)).getField("role").alias("role"))
    )
    return MovieGraph(person, movie, acted, acted.select("person_id", "movie_id").limit(0))


def _played(g: MovieGraph, edge: DataFrame) -> DataFrame:
    return edge.join(g.person, "person_id").join(g.movie, "movie_id")


def _named(column: str, value: str, exact: bool) -> Column:
    return F.col(column) == value if exact else F.contains(F.col(column), F.lit(value))


def actors_of(g: MovieGraph, movie: str, exact: bool = True) -> DataFrame:
    return _played(g, g.acted_in).filter(_named("title", movie, exact)).select(F.col("name").alias("actor"), "role")


def _titles(g: MovieGraph, edge: DataFrame, name: str, exact: bool) -> DataFrame:
    rows = _played(g, edge).filter(_named("name", name, exact)).select(F.col("title").alias("movie"), "year")
    return rows.orderBy(F.asc_nulls_last("year"), "movie")


def movies_of(g: MovieGraph, actor: str, exact: bool = True) -> DataFrame:
    return _titles(g, g.acted_in, actor, exact)


def director_of(g: MovieGraph, movie: str, exact: bool = True) -> DataFrame:
    return _played(g, g.directed).filter(_named("title", movie, exact)).select(F.col("name").alias("director"))


def directed_by(g: MovieGraph, director: str, exact: bool = True) -> DataFrame:
    return _titles(g, g.directed, director, exact)


def movies_in_year(g: MovieGraph, year: int, since: bool = False) -> DataFrame:
    hit = F.col("year") >= year if since else F.col("year") == year
    return g.movie.filter(hit).select(F.col("title").alias("movie"), "year").orderBy(F.desc_nulls_first("year"), "movie")


def movies_in_genre(g: MovieGraph, genre: str) -> DataFrame:
    hit = F.contains(F.lower("genre"), F.lower(F.lit(genre)))
    return g.movie.filter(hit).select(F.col("title").alias("movie"), "year").orderBy("movie")


def genres(g: MovieGraph) -> DataFrame:
    """Vertices (``genre_id``, ``name``) of the genres that movies have."""
    return g.movie.select("genre").filter("genre is not null").distinct().select(F.col("genre").alias("genre_id"), F.col("genre").alias("name"))


def in_genre(g: MovieGraph) -> DataFrame:
    """Edges (``movie_id``, ``genre_id``) from movies to their genres."""
    return g.movie.filter("genre is not null").select("movie_id", F.col("genre").alias("genre_id")).distinct()


def movies_of_genre(g: MovieGraph, genre: str) -> DataFrame:
    """Movies by an edge to the genre vertex of this name, latest first."""
    hits = in_genre(g).join(genres(g).filter(F.col("name") == genre), "genre_id").join(g.movie, "movie_id")
    return hits.select(F.col("title").alias("movie"), "year").orderBy(F.desc_nulls_first("year"), "movie")


def latest_movies(g: MovieGraph, rows: int = 20) -> DataFrame:
    """The latest movies with genre and year: what a question about a genre gets that names none."""
    return g.movie.select(F.col("title").alias("movie"), "genre", "year").orderBy(F.desc_nulls_first("year"), "movie").limit(rows)


def release_year(g: MovieGraph, movie: str, exact: bool = True) -> DataFrame:
    return g.movie.filter(_named("title", movie, exact)).select(F.col("title").alias("movie"), "year")


def count_movies(g: MovieGraph, actor: str | None = None, exact: bool = True) -> DataFrame:
    """One row: the movies of an actor (of all without one); 0 if there is none."""
    if actor is None:
        return g.movie.agg(F.count(F.lit(1)).alias("movie_count"))
    hit = F.col("name") == actor if exact else F.contains(F.col("name"), F.lit(actor))
    return g.acted_in.join(g.person.filter(hit), "person_id").agg(F.count(F.lit(1)).alias("movie_count"))


def coactors(g: MovieGraph, actor: str) -> DataFrame:
    """Distinct (``coactor``, ``movie``); the two edges of a movie must differ, so nobody is a coactor of themselves."""
    own = g.acted_in.join(g.person.filter(F.col("name") == actor), "person_id").select("movie_id", F.col("person_id").alias("__own"))
    others = g.acted_in.join(own, "movie_id").filter(F.col("person_id") != F.col("__own"))
    return others.join(g.person, "person_id").join(g.movie, "movie_id").select(F.col("name").alias("coactor"), F.col("title").alias("movie")).distinct()


def path_between(g: MovieGraph, first: str, second: str, max_depth: int | None = None) -> DataFrame:
    """The shortest path between two persons over movies they acted in or directed."""
    edges = g.acted_in.select("person_id", "movie_id").unionByName(g.directed.select("person_id", "movie_id")).join(g.person, "person_id").join(g.movie, "movie_id")
    return shortest_path(edges.select(F.concat(F.lit("p:"), "name").alias("src"), F.concat(F.lit("m:"), "title").alias("dst")), f"p:{first}", f"p:{second}", max_depth)


def bipartite(g: MovieGraph) -> DataFrame:
    """One row per (person, movie) pair with the relationship; a directed edge replaces an acted one; a null genre is 'Unknown'."""
    acted = g.acted_in.select("person_id", "movie_id", F.lit(0).alias("seq"), F.lit("ACTED_IN").alias("relationship"))
    directed = g.directed.select("person_id", "movie_id", F.lit(1).alias("seq"), F.lit("DIRECTED").alias("relationship"))
    last = acted.unionByName(directed).groupBy("person_id", "movie_id").agg(F.max_by("relationship", "seq").alias("relationship"))
    return last.join(g.person, "person_id").join(g.movie, "movie_id").select("name", "title", "relationship", F.coalesce("genre", F.lit("Unknown")).alias("genre"))


def genre_subgraph(g: MovieGraph, genre: str) -> DataFrame:
    """The edges of a genre's movies."""
    return bipartite(g).filter(F.col("genre") == genre)


@dataclass(frozen=True)
class Question:
    """One way to answer an intent: the entities it needs and the builder that takes their values."""

    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


def _both(needs: str, build: Callable[..., DataFrame]) -> tuple[Question, ...]:
    """A name as it is, then a part of a name."""
    return Question((needs,), build), Question((needs,), lambda g, value: build(g, value, exact=False))


#: Intent -> the ways to answer it, best first; the last is what is left if no way's entities are named.
INTENTS: dict[str, tuple[Question, ...]] = {
    "find_actors": _both("movie", actors_of),
    "find_movies_by_actor": _both("actor", movies_of),
    "find_director": _both("movie", director_of),
    "find_movies_by_director": _both("director", directed_by),
    "find_movies_by_year": (Question(("year",), movies_in_year), Question(("year",), lambda g, year: movies_in_year(g, year, since=True))),
    "find_movies_by_genre": (Question(("genre",), movies_of_genre), Question(("genre",), movies_in_genre), Question((), latest_movies)),
    "find_release_year": _both("movie", release_year),
    "count_movies": (*_both("actor", count_movies), Question((), count_movies)),
    "find_path": (Question(("actor", "actor2"), path_between),),
    "find_coactors": (Question(("actor",), coactors),),
}
#: Older names of intents, compared in lower case.
INTENTS["find_actors_in_movie"] = INTENTS["find_actors"]
