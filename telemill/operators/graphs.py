"""Graphs given as DataFrames of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a task sorts and groups at once, about.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows by hash of ``by``, in as many partitions as they ask for, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *by)


def _stars(edges: DataFrame, large: bool, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One star step over undirected edges (hi, lo) with hi > lo.

    Large: every node hands its larger neighbours to the smallest of its neighbourhood.  Small: every node hands its
    smaller neighbours, and itself, to it.
    """
    if large:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Spark splits the edges of a hub over tasks only if nothing but a shuffle stands below the join.
        joined = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(cut(least), "u")
        return joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    step = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
    return step.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node that can be reached.

    ``edges`` has two columns of ids of one type; loops, repeated edges and rows with a null are ignored; no edges, no
    rows.  Large and small stars alternate: each round is an aggregation, which combines before it shuffles, and a
    join, which Spark can split where one node has very many neighbours, so no task and no driver ever holds all edges.
    The number of rounds grows with the logarithm of the number of nodes.  ``cut`` ends the lineage after a round (a
    reliable checkpoint unless given).
    """
    cut = cut or (lambda df: df.checkpoint())
    a, b = edges.columns
    now = edges.where(f"`{a}` != `{b}`").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = cut(now)
    for _ in range(rounds):
        # Done when all edges are stars: nothing has two lower ends, and no lower end has one itself.
        ends = now.select(F.col("hi").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("is_lower"))
        ends = ends.unionByName(now.select(F.col("lo").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("is_lower")))
        ends = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("is_lower").alias("is_lower"))
        if not ends.where("lower > 1 or lower = is_lower").limit(1).count():
            break
        now = cut(_stars(_stars(now, True, cut), False, cut))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def connectedness(df: DataFrame, by: list[str], u: str, v: str) -> DataFrame:
    """(by, nodes, edges, connectedness): share of possible undirected edges that exist; null below two nodes.

    Nodes and edges are told apart by one distinct of pairs, a node being a pair with itself, so rows that are already
    dealt by ``by`` aren't shuffled again.
    """
    pair = lambda a, b: F.struct(F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"))
    both = df.where(F.col(u).isNotNull() & F.col(v).isNotNull())
    pairs = both.select(*by, F.explode(F.array_distinct(F.array(pair(u, u), pair(v, v), pair(u, v)))).alias("__p"))
    pairs = pairs.select(*by, "__p.__a", "__p.__b").distinct()
    out = pairs.groupBy(*by).agg(F.count_if(F.col("__a") == F.col("__b")).alias("nodes"), F.count_if(F.col("__a") != F.col("__b")).alias("edges"))
    return out.withColumn("connectedness", F.try_divide(2.0 * F.col("edges"), F.nullif((F.col("nodes") * (F.col("nodes") - 1)).cast("double"), F.lit(0.0))))
