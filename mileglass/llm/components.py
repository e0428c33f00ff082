"""Connected components of a large link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mileglass.llm.text import stored

ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that has a link; ``root`` is the smallest node reachable.

    Each round makes two star steps: a large-star step hands the smallest neighbour to all larger neighbours of a
    node, a small-star step hands it to all smaller ones and the node itself.  Both are a minimum with partial
    aggregation and one join whose hot side AQE can split, so a node with a third of all links is no bottleneck.
    Rounds grow with the logarithm of the longest chain; every round's links are a table in the shared folder.
    Links of a node to itself, repeated links and links with NULL are harmless.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        large = _star(edges.union(edges.select("v", "u")), upper=True)
        small = _star(large, upper=False)
        edges = stored(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")),
                              F.sum(F.col("u").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")


def _star(edges: DataFrame, upper: bool) -> DataFrame:
    """Links (u, v) replaced by links of the neighbours to the smallest of them and the node itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    if upper:  # both directions given: pass m to every larger neighbour
        passed = (edges.filter(F.col("v") > F.col("u")).join(least, "u")
                  .select(F.col("v").alias("u"), F.col("m").alias("v")))
    else:  # links point from larger to smaller: pass m to every neighbour, and to the node
        passed = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .union(least.select("u", F.col("m").alias("v"))))
    return passed.filter(F.col("u") != F.col("v")).distinct()
