"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _ends(links: DataFrame) -> tuple:
    """Fingerprint of a set of links: equal before and after a round when nothing changed."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of a link, the smallest node it can reach.

    ``links`` may hold loops, repeats and both directions; rows with a null end are no
    links. Each round hangs larger neighbours, then smaller ones, on the smallest
    neighbour; the number of rounds grows with the logarithm of a component's size.
    A hub costs one row per neighbour in a round: its minimum is combined on the map side
    and joined back, so no task gathers a neighbourhood. No node is sent to the driver.
    """
    clean = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    links, seen = stage(clean, "links"), None
    while (now := _ends(links)) != seen:
        seen = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = stage(large, "links")
        # Each node v with smaller neighbours: they and v hang on the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        hung = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v"))
        links = stage(hung.where("u < v").distinct(), "links")
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("component")))
