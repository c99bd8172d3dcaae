"""Connected components of links between long ids, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of (a, b): root is the smallest id reachable.

    Large-star and small-star rounds: each hangs a node's neighbours below the smallest
    of them, so that the links become stars after about as many rounds as the logarithm
    of the longest path.  A round is two joins with one row per node on one side, which a
    node with very many links cannot bind to one task.  Links to oneself and links with a
    null end add nothing; no links give no rows.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            # a node that is itself the smallest keeps its links to larger ones
            least.where("m < u").select("u", F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v")).distinct()
