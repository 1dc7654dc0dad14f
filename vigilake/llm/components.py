"""Connected components of a links table, without collecting any of it.

Every vertex hooks to its smallest neighbour; pointers are jumped to the root; the links between roots go on to the
next pass. Long chains take a logarithmic number of joins.

Defined results: an empty table, or one of links of vertices with themselves, gives an empty table; repeated links and links
in either direction count once; a null end joins nothing. Joins on the centre of a star are plain equi-joins of shuffled
sides, whose large keys Spark splits; all else is aggregated before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def roots(parents: DataFrame) -> DataFrame:
    """(v, p) with p < v or a root's own row, each p itself a v: (v, root of v)."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = settle(parents.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        discard(parents)
        parents = jumped.drop("moved")
        parents._settled_at = jumped._settled_at
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of ids. Returns (v, c) for every id in a link; c is the smallest id reachable."""
    links = settle(links.where("a != b").select("a", "b"))
    out = None
    if not links.limit(1).count():
        return links.select(F.col("a").alias("v"), F.col("b").alias("c"))
    while True:
        both = links.union(links.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        found = roots(settle(hooked))
        if out is None:
            step = found.select("v", F.col("p").alias("c"))
            now = settle(step)
        else:
            up = found.select(F.col("v").alias("c"), F.col("p").alias("cc"))
            now = settle(out.join(up, "c", "left").select("v", F.coalesce("cc", "c").alias("c")))
        a, b = found.select(F.col("v").alias("a"), F.col("p").alias("ra")), found.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        left = settle(links.join(a, "a").join(b, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        discard(links, out, found)
        links, out = left, now
        if not links.limit(1).count():
            discard(links)
            return out
