"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    """Order-free summary of an edge list, computed on the executors."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round: every node's neighbours move to its smallest neighbour. A hub's row count stays with its
    partial minimum, and the join back is an inner equi-join, which adaptive execution splits when a hub is hot."""
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its smallest reachable node.

    Null ends and self-loops are ignored; an empty edge table gives an empty result. Each round is stored in the
    shared folder, so a lost executor costs that round only; the round before is deleted."""
    now = edges.where(f"{src} IS NOT NULL AND {dst} IS NOT NULL AND {src} != {dst}")
    now = materialize(now.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        before, last = state, now
        now = materialize(_star(_star(now, small=False), small=True), "edges")
        state = _state(now)
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
