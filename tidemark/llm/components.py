"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keep


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moves(edges: DataFrame, turn: int) -> DataFrame:
    """(a, to) for each node: the first of it and its neighbours in the order of the round.

    Even rounds put nodes with many neighbours first, so a star is gone after one of them; odd ones
    are random, so that no graph is slow in all of them.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def rank(c: str, degree: str | None = None) -> Column:
        drawn = F.xxhash64(F.lit(turn), F.col(c)).alias("h")
        return F.struct(*([(-F.col(degree)).alias("d")] if degree else []), drawn, F.col(c).alias("id"))

    if turn % 2:
        return (both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                .select("a", F.least(F.col("m"), rank("a"))["id"].alias("to")))
    degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    best = (both.join(degrees.select(F.col("a").alias("b"), "n"), "b")
            .groupBy("a").agg(F.min(rank("b", "n")).alias("m")))
    return best.join(degrees, "a").select("a", F.least(F.col("m"), rank("a", "n"))["id"].alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); component is the smallest id in it.

    In each round every node moves to that neighbour, or stays where it is, which comes first
    in the order of the round, and edges are contracted accordingly. In a random order about a third
    of the nodes or more goes each time, also on long chains, so the rounds grow with the logarithm of
    the longest part. A hub moves nobody twice: minima are combined before they are shuffled.
    Edges with a null end are left out. Tables between rounds are written to the shared folder.
    """
    edges = keep(_tidy(edges.where("a is not null and b is not null")))
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        moves = keep(_moves(edges, len(steps)))
        first = moves.select("a", F.col("to").alias("x"))
        second = moves.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = keep(_tidy(edges.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
        steps.append(moves)
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    where = steps[0].select(F.col("a").alias("id"), F.col("to").alias("at"))
    for moves in steps[1:]:
        step = moves.select(F.col("a").alias("at"), "to")
        where = where.join(step, "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    where = keep(where)
    least = where.groupBy("at").agg(F.min("id").alias("component"))
    return where.join(least, "at").select("id", "component")
