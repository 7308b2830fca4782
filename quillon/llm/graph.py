"""Connected components of a graph held as a table of edges, by contraction.

Each round every vertex takes the neighbour of least rank (ranks are hashes drawn anew each
round, so chains shrink by a constant factor), pointers are followed to their roots, and edges
are rewritten to roots. Every table is cut, so that joins read two fresh shuffles and Spark can
split a vertex of high degree; minima are aggregated before they are shuffled.

Defined results: an edge of a vertex with itself and a repeated one change nothing, and a vertex with
no other edge is in no component; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``a`` and ``b``; returns ``v, root`` for every vertex that has
    an edge to another. ``root`` is one vertex of the component, the same for all its members."""
    once = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = lambda df: df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    e = cut(once(edges), "edges")
    maps: list[DataFrame] = []
    for n in range(1 << 30):
        if e.isEmpty():
            break
        rank = lambda c: F.xxhash64(c, F.lit(n))  # noqa: B023, E731
        least = both(e).groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        p = cut(least.select(F.col("a").alias("v"), F.when(F.struct(F.col("m.h"), F.col("m.v")) < F.struct(rank("a"), F.col("a")), F.col("m.v")).otherwise(F.col("a")).alias("root")), "parents")
        while True:
            up = p.select(F.col("v").alias("root"), F.col("root").alias("next"))
            q = cut(p.join(up, "root").select("v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
            forget(p)
            p = q.select("v", "root")
            if q.filter("moved").isEmpty():
                break
        maps.append(p)
        side = lambda c: p.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        half = cut(e.join(side("a"), "a").select(F.col("ra").alias("a"), "b"), "half")
        new = cut(once(half.join(side("b"), "b").select("a", F.col("rb").alias("b"))), "edges")
        forget(e), forget(half)
        e = new
    if not maps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        after = m.select(F.col("v").alias("root"), F.col("root").alias("next"))
        out = cut(out.join(after, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "labels")
    return out
