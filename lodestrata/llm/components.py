"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is a shuffle of the links with partial aggregation before it; links never come to the driver. The number of
rounds follows the logarithm of the components' width. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (two columns of ids, either way round, repeats and loops allowed) -> (id, component): the smallest id
    that can be reached from each id that has a link to another id."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stored(now, "links")
    while True:
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join can split a node that very many others link to
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours go to the smallest of them
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(star.select("e.u", "e.v").where("u <> v").distinct(), "links")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        drop_stored(now)
        drop_stored(least)
        now = after
        if same:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
