"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calorine.functions.session import discard, saved


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(u, v); component is its least reachable node.

    Alternating stars: each round points every neighbour at the least node it can
    see, first among larger neighbours and then among smaller ones, so path-like
    components shrink geometrically. Only per-node minima are aggregated (with
    map-side combine); a node of any degree is never gathered in one task. Each
    round is written to the shared folder, and the one before it removed. Self-loops and nulls are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and u <> v").distinct()
    e = saved(e, "components")
    state = _fingerprint(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        earlier, e = e, saved(down.union(low).where("u <> v").distinct(), "components")
        discard(earlier, large)
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
