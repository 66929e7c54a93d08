"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle) and a salted
join, so a vertex with very many neighbours is never one task's work.  No
step makes more edges than it gets: once there are at most ``SMALL_EDGES``,
the minima are broadcast instead and a step is written as a few files.
Above, the salted join is a merge join at every size: the minima grow with
the edges, and Spark sizes them by their compressed files and without the
sixteen copies.
Every step is written to the shared folder, which cuts the lineage: a lost
executor costs its tasks, not the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import salted_left_join
from revlens.session import materialize

SMALL_EDGES = 50_000  # their minima, at most two a row, are broadcast
SMALL_PARTS = 16


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex of ``edges``; component is the smallest id that it reaches.

    Direction, repeats, self-loops and nulls in ``edges`` do not matter; a
    vertex without an edge to another has no row.  No edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, mark = _state(edges)
    while mark[0]:
        small = mark[0] <= SMALL_EDGES
        parts = SMALL_PARTS if small else None
        large = materialize(_large_star(edges, small), "cc-large", parts)
        new, m = _state(_small_star(large, small), parts)
        if m == mark:
            break
        edges, mark = new, m
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ids.union(roots)


def _state(edges: DataFrame, parts: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a mark that changes with them; its first value is their number."""
    t = materialize(edges, "cc", parts)
    row = t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return t, tuple(row)


def _with_least(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    return edges.join(F.broadcast(least), "u", "left") if small else salted_left_join(edges, least.hint("merge"), ["u"], F.col("v"))


def _large_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the smallest of the vertex and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = _with_least(both.filter("v > u"), least, small)
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    j = _with_least(edges, least, small)
    links = j.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(least.select("u", F.col("m").alias("v"))).distinct()
