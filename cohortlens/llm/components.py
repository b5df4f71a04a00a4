"""Connected components of an undirected graph given as an edge frame.

Alternating large-star / small-star rounds: every edge is moved towards the
smallest node it can see until each component is one star around its smallest
node. A round is two grouped minima (pre-aggregated before the shuffle) and
two joins, so a node with very many edges is split by AQE like any skewed
join key, and no component is ever gathered in one task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point from the larger node a to a smaller b.
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; ``root`` is the component's smallest node.

    ``edges`` has two columns of one orderable type. Rows with a null end and
    self loops are ignored; repeated edges are harmless.
    """
    x, y = edges.columns
    e = (edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
         .filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).distinct())
    e = stored(e, "cc-edges")
    digest = None
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e)), "cc-edges")
        # The edge set as a fingerprint: unchanged means every component is a star.
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
