"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolume.llm.common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node of its component.

    Each round maps every node to the smallest of its neighbours and itself and replaces edges by the
    edges between what their ends map to, until none is left. Stars and cliques take one or two rounds,
    paths a logarithmic number. Every step is a grouping or a join with partial sums; no list of
    neighbours is ever built.
    """
    spark = edges.sparkSession
    left, used = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "graph-edges")
    labels, last = spark.createDataFrame([], f"node {left.schema['a'].dataType.simpleString()}, label {left.schema['a'].dataType.simpleString()}"), None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, up_path = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "graph-up")
        one, two = (up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = left.join(one, "a").join(two, "b").filter("a_to <> b_to")
        left, path = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "graph-edges")
        forget(spark, used)
        used = path
        if last is None:
            labels, last = up.select("node", F.col("to").alias("label")), up_path
        else:
            onto = up.select(F.col("node").alias("label"), "to")
            labels, path = written(labels.join(onto, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "graph-labels")
            forget(spark, last, up_path)
            last = path
    forget(spark, used)
    return labels
