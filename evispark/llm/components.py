"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import saved


def components(edges: DataFrame, a: str, b: str, name: str = "stars") -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node that can be reached.

    Self-links, repeated links and nulls are allowed and add nothing; no links give no rows. Each round rewires
    every node to the smallest neighbour, first for its larger, then for its smaller neighbours, until nothing
    changes; a chain of n links takes about log n rounds. Rounds are written to the shared folder. A node with very
    many links only meets min(), which is combined before the shuffle, and a join that adaptive execution splits.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links, before = saved(links, name), None
    while True:
        found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == before or not found[0]:
            break
        before = tuple(found)
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = saved(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct(), name)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select("v", "v").distinct())
