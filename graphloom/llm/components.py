"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregate (combined before the shuffle) and a join on the vertex, whose skewed partitions the adaptive
planner can split; a hub of any degree is never gathered. Each round is cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (vertex, root): root is the smallest vertex that can be reached.

    Links with a null end are left out; self links and repeated links change nothing; vertices without links to another
    vertex do not appear.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(least.select("u", F.col("m").alias("v")).unionByName(rest).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
