"""Near-duplicate vectors: an exact metric range join by cosine.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots partition the vectors: each vector has
its nearest pivot's cell as home and is copied to every other cell whose border is within reach. With home pivot i and
another pivot j, a partner at home in cell j can exist only if d(x, j) <= d(x, i) + 2r (triangle inequality) and
d(x, j)^2 - d(x, i)^2 <= 2 r d(i, j) (distance to the plane between both pivots). Cells then join independently. A large
cell is dealt into square blocks, so that no task holds a whole cell; blocks give link counts and a spanning set of
links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import materialize
from lonja.llm.graph import connected_components

COSINE = 0.98
#: Vectors per pivot aimed at, most pivots (their array is broadcast: 1024 * dimensions * 8 bytes), vectors per block.
PER_PIVOT, MOST_PIVOTS, BLOCK = 16_384, 1_024, 1_024
_SLACK = 1e-9


def _prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors as bytes, and a digest by which equal vectors are one node."""
    for pdf in frames:
        vectors = [np.asarray(x, dtype=np.float64) for x in pdf["embedding"]]
        units = []
        for v in vectors:
            v = v / np.abs(v).max()
            units.append((v / np.sqrt(v @ v)).tobytes())
        yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "dim": [len(v) for v in vectors], "digest": [xxhash.xxh3_128_hexdigest(v.tobytes()) for v in vectors], "vec": units})


def _assign(pivots, r: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = {d: (p, np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))) for d, p in pivots.value.items()}
        for pdf in frames:
            for dim, part in pdf.groupby("dim", sort=False):
                part = part.reset_index(drop=True)
                if dim not in by_dim:
                    yield part.assign(cell=0, home=True)
                    continue
                p, between = by_dim[dim]
                x = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(len(part), dim)
                d2 = np.maximum(0, 2 - 2 * x @ p.T)
                home = d2.argmin(1)
                own = d2[np.arange(len(x)), home][:, None]
                reach = (np.sqrt(d2) <= np.sqrt(own) + 2 * r + _SLACK) & (d2 - own <= 2 * r * between[home] + _SLACK)
                reach[np.arange(len(x)), home] = True
                rows, cells = np.nonzero(reach)
                yield part.iloc[rows].reset_index(drop=True).assign(cell=cells, home=home[rows] == cells)

    return run


def _block(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Queries (at home in this cell) against members: links of each query, and links that span what is found."""
        asks, gives = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if asks.empty or gives.empty:
            return empty
        dim = int(pdf["dim"].iloc[0])
        a = np.frombuffer(b"".join(asks["vec"]), np.float64).reshape(-1, dim)
        b = np.frombuffer(b"".join(gives["vec"]), np.float64).reshape(-1, dim)
        a_id, b_id = asks["node"].to_numpy(), gives["node"].to_numpy()
        hit = (a @ b.T >= cosine) & (a_id[:, None] != b_id[None, :])
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return empty
        hit, links = hit[np.ix_(rows, cols)], (hit[rows] * gives["weight"].to_numpy()[None, :]).sum(1)
        x, y, far = a_id[rows].copy(), b_id[cols].copy(), np.iinfo(np.int64).max
        while True:
            x2 = np.minimum(x, np.where(hit, y[None, :], far).min(1))
            y2 = np.minimum(y, np.where(hit, x2[:, None], far).min(0))
            if (x2 == x).all() and (y2 == y).all():
                break
            x, y = x2, y2
        return pd.DataFrame({"node": np.concatenate((a_id[rows], b_id[cols])), "links": np.concatenate((links, np.zeros(len(cols), np.int64))), "root": np.concatenate((x, y))})

    return run


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors.

    Rows link when their labels are equal and not null and the cosine, in double precision, is at least ``cosine``.
    n_links counts the other rows linked directly, repeated rows included; component_id is the smallest id reachable;
    kept says that the row has that id. Vectors that are null, empty, zero or hold null or non-finite components, rows
    with a null label or id, and vectors of different lengths link with nothing (n_links 0, component_id the own id; a
    null id: component_id null, kept true). An empty table: no rows. Other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    schema = "vec_id long, label string, dim int, digest string, vec binary"
    ready = materialize(valid.mapInPandas(_prepare, schema).withColumn("node", F.xxhash64("label", "dim", "digest")), "unit-vectors")
    nodes = ready.groupBy("label", "dim", "node").agg(F.count("*").alias("weight"), F.first("vec").alias("vec"))
    r = float(np.sqrt(2 - 2 * cosine))
    n = ready.count()
    wanted = min(MOST_PIVOTS, -(-n // PER_PIVOT))
    pivots: dict[int, list] = {}
    for row in ready.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "node").limit(wanted).select("dim", "vec").collect() if n else []:
        pivots.setdefault(row["dim"], []).append(np.frombuffer(row["vec"], np.float64))
    shared = spark.sparkContext.broadcast({d: np.unique(np.stack(v), axis=0) for d, v in pivots.items()})
    placed = nodes.mapInPandas(_assign(shared, r), "label string, dim int, node long, weight long, vec binary, cell int, home boolean")
    placed = materialize(placed, "cells")
    cell = ["label", "dim", "cell"]
    counts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(counts, cell).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    asks = dealt.where("home").select(*cell, "node", "weight", "vec", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    gives = dealt.select(*cell, "node", "weight", "vec", every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    found = asks.unionByName(gives).groupBy(*cell, "i", "j").applyInPandas(_block(cosine), "node long, links long, root long")
    found = materialize(found, "vector-links")
    parts = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = ready.select("vec_id", "node").join(links, "node", "left").join(nodes.select("node", "weight"), "node", "left").join(parts, "node", "left")
    placed = placed.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    heads = placed.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(heads, "part").select("vec_id", "n_links", "component_id")
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
