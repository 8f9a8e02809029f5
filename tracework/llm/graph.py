"""Connected components of an edge table by repeated contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.repeats import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node of ``edges`` (columns ``a``, ``b``; no nulls).

    Each round points every node to its smallest neighbour, follows the pointers twice, and replaces the ends of all edges by what
    they point to; edges inside a group vanish. The edge table shrinks from round to round and is written to the shared
    folder, so lineage stays short. Stars of any size cost one pre-aggregated minimum; nothing is collected.
    """
    pairs = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    place = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "pointers")
        for _ in range(2):
            higher = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = up.join(higher, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        up = stored(up, "pointers")
        first, second = up.toDF("a", "pa"), up.toDF("b", "pb")
        pairs = stored(pairs.join(first, "a").join(second, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        place = stored(place.join(up.toDF("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "places")
    return place
