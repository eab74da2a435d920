"""Connected components by alternating star contractions, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node. ``edges``: two columns of one orderable type.

    Large stars hang a node's larger neighbours on its smallest, small stars the rest; both only use a minimum for each node and a join, and the
    number of rounds grows with the logarithm of the longest path. Every round is written to the shared checkpoint folder. No edges: no rows.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = None
    while (seen := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != mark and seen[0]:
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
