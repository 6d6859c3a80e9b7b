"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Of the edges (a, b): one row (id, component) for each id that is not the
    smallest of its component; ``component`` is that smallest id.

    Each round hooks every vertex to its smallest smaller neighbour, follows the
    parents to their roots by pointer jumping, and contracts the edges to the
    roots, until none are left. Nothing is gathered in one place: a vertex with
    very many edges is summed up before the shuffle, and joins look parents up,
    one row for a key on one side. Edges with a null end and loops link nothing.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    todo = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(low, high).distinct(), "edges")
    found = None
    while not todo.isEmpty():
        first = todo
        parents = _roots(materialise(todo.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")), "parents"))
        for end in ("a", "b"):
            p = parents.select(F.col("id").alias(end), "parent")
            todo = todo.join(p, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        before, todo = first, materialise(todo.where("a <> b").select(low, high).distinct(), "edges")
        discard(before)
        if found is not None:
            above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            kept = found.join(above, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"))
            before, parents = (found, parents), materialise(kept.unionByName(parents), "parents")
            for table in before:
                discard(table)
        found = parents
    if found is None:
        return todo.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.withColumnRenamed("parent", "component")


def _roots(parents: DataFrame) -> DataFrame:
    """Parents of parents until all are roots."""
    while True:
        above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        further = parents.join(above, "parent", "left")
        further = materialise(further.select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        discard(parents)
        parents = further.select("id", "parent")
        parents._scratch_path = further._scratch_path
        if further.where("moved").isEmpty():
            return parents
