"""Connected components of a graph in a DataFrame: distributed union-find by least neighbours and contraction.

In a round each node hooks onto the least of itself and its neighbours, and pointer jumping, which doubles its reach with
each jump, takes every node to the root of the tree it then hangs in. The edges are rewritten to the roots, those
inside a tree go, and equal ones are one: so each edge is joined twice in a round (a row for each node on the other
side), and the next round has only what still joins different trees. At the end the rounds are put together from the
last to the first. A node's least neighbour comes of an aggregation of minima, which combines before it shuffles; the
edges of a node with very many meet that node's row by a join, which adaptive execution splits where they make a
partition too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _fresh(df: DataFrame) -> DataFrame:
    """``df``, settled, without the size estimates of its plan: a checkpoint keeps them, and as a join multiplies
    them, their digits would double with each round, until the driver does nothing but multiply."""
    spark, settled = df.sparkSession, settle(df)
    rows = settled._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, settled._jdf.schema(), False), spark)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node on an edge; ``component`` is the least node of its component.

    ``a`` and ``b`` are of one orderable type. Edges from a node to itself, and repeated edges, change nothing;
    edges with a null end are left out; no edges give no rows.
    """
    u, v = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    left = _fresh(edges.where(F.col(a) != F.col(b)).select(u, v).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        of = _fresh(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("at")))
        moves = True
        while moves:
            jumped = of.join(of.select(F.col("node").alias("at"), F.col("at").alias("root")), "at")
            new = _fresh(jumped.select("node", F.col("root").alias("at"), (F.col("root") != F.col("at")).alias("_new")))
            of, moves = new.select("node", "at"), not new.where("_new").isEmpty()
        steps.append(of)
        side = lambda x, of=of: of.select(F.col("node").alias(x), F.col("at").alias(f"_{x}"))
        moved = left.join(side("u"), "u").join(side("v"), "v").where(F.col("_u") != F.col("_v"))
        left = _fresh(moved.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = steps.pop().withColumnRenamed("at", "component")
    while steps:
        joined = steps.pop().join(out.withColumnRenamed("node", "at"), "at", "left")
        out = _fresh(joined.select("node", F.coalesce("component", "at").alias("component")))
    return out
