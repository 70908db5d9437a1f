"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``): the least node that undirected links (``src``, ``dst``) reach.

    Alternating large-star and small-star rounds; each halves the distance to the least node, so the rounds are
    logarithmic in the longest chain. Every round is written to the checkpoint folder. Loops and repeated links change
    nothing, links with a null end are left out, and no links give no rows.
    """
    edges = links.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("u"),
        F.least("src", "dst").alias("v"),
    )
    edges = cut_lineage(edges.distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(
            F.col("v").alias("u"),
            F.col("m").alias("v"),
        ).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        small = cut_lineage(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
