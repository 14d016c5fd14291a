"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step: every node's neighbours are tied to the smallest of them."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    tied = pairs.join(lowest, "u")
    if both_ways:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = tied.where(F.col("v") != F.col("low")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges (a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps until the edge set stays the same. Each round's edges are written to
    the shared folder. Hot nodes cost no gathering: a minimum with map-side combining and an equi-join that adaptive
    execution may split. An empty table gives an empty table; rows with a null end are ignored. ``discard`` takes the
    result.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        last, now = now, materialise(_stars(_stars(now, True), False), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out._scratch = now._scratch
    return out
