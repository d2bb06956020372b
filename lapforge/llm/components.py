"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and an equi-join
that adaptive execution may split, so a hub that holds most links is never gathered
in one task. A round's links are written to the shared folder, which cuts lineage and
lets a lost executor's work be read again. Nothing is collected but one flag a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (u, v) of either direction."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the least node has no smaller neighbour; its links are kept from the other side
    large = large.filter("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node but the least of its component links to that one alone."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of links (u, v) but each component's least.

    ``component`` is the least node reachable. Links may come in any direction and
    repeat; a link to itself says nothing. No links: no rows.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        if _settled(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        links = materialize(_round(links), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
