"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes log-count ratios.

Training takes a bounded sample of the labelled rows: SAMPLE rows of each label, those with the smallest hash of their
id. Presence counts of hashed n-grams are summed up block by block and give the log-count ratios; all n-grams that
differ significantly between the labels are kept, and a logistic regression is fitted on the ratios of the n-grams that
a text holds, in one task, since the sample is bounded. Only kept n-grams and their weights reach the driver. The bias is moved from the sample's label shares to
those of all training rows, so that scores do not depend on how much was sampled. Scoring reads every whole text once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bounded_batches, trim

#: Orders of the n-grams, bits of their hash, sampled rows of each label (a documented bound).
ORDERS, BITS, SAMPLE = (3, 4, 5), 20, 4_000
#: Score from which a text counts as toxic, and the texts held out: crc32(id as text) mod 4 = 2.
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
#: Standard errors by which the share of texts with an n-gram differs between the labels, for the n-gram to be kept:
#: others would add up to noise in long texts.
SIGNIFICANT = 4.5
#: Characters hashed at a time, and entries of a block of rows in the fit (it stays in the cache).
_PIECE, _BLOCK = 1 << 20, 1 << 17
#: Buckets whose counts are summed up together.
_SUMMED = 1 << 14
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hash bucket of the n-gram at every place, order by order."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] + codes[n - 1 :] * np.uint64(_MIX[n - 1])
        if n in ORDERS:
            yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - BITS)


def _present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a whole text's n-grams: lower case, runs of white space as one space, a space at both ends."""
    text = " " + " ".join((text or "").lower().split()) + " "
    found = []
    for at in range(0, len(text), _PIECE):  # pieces overlap by the longest n-gram less one
        piece = text[at : at + _PIECE + max(ORDERS) - 1]
        for b in _buckets(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)):
            found.append(np.unique(b if wanted is None else b[wanted[b]]))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a bucket, for a partition: a row for each block of buckets that has any."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            total[label][_present(text.as_py())] += 1
    trim()
    blocks = total.reshape(2, -1, _SUMMED)
    full = [k for k in range(blocks.shape[1]) if blocks[:, k].any()]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(blocks[:, k].tobytes(), 1) for k in full], pa.binary())], ["block", "counts"])


def _significant(n: dict[int, int]):
    """The buckets of a block whose share of texts differs significantly between the labels, and their ratios."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).reshape(2, -1).astype(np.int64) for x in group["counts"])
        p, q = (total[1] + 1) / (n[1] + 2), (total[0] + 1) / (n[0] + 2)
        ratio = np.log(p / q) - np.log((1 - p) / (1 - q))
        share = total.sum(0) / (n[0] + n[1])
        strength = np.abs(total[1] / n[1] - total[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
        best = np.flatnonzero(strength >= SIGNIFICANT)
        return pd.DataFrame({"block": [key[0]], "buckets": [(best + key[0] * _SUMMED).astype("<i4").tobytes()], "ratios": [ratio[best].astype("<f8").tobytes()]})

    return run


def _picked(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[kept.value[0]] = True
        for batch in batches:
            rows = [_present(t.as_py(), wanted) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary())], ["toxic", "buckets"])

    return run


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the ratios of present features, full batches, adaptive steps. Rows are taken block by
    block, so that the memory besides the rows themselves is bounded."""
    blocks, begin = [], 0
    while begin < len(rows):
        end, n = begin, 0
        while end < len(rows) and (end == begin or n + len(rows[end]) <= _BLOCK):
            end, n = end + 1, n + len(rows[end])
        blocks.append((begin, end, np.repeat(np.arange(end - begin, dtype=np.int32), [len(r) for r in rows[begin:end]]), np.concatenate(rows[begin:end])))
        begin = end
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        g, scaled = np.append(l2 * w / len(y), 0.0), ratio * w
        for begin, end, owner, column in blocks:
            z = np.bincount(owner, scaled[column], minlength=end - begin) + b
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[begin:end]) / len(y)
            g[:-1] += ratio * np.bincount(column, error[owner], minlength=len(ratio))
            g[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, float(b)


def _fitted(kept):
    """Weights of the kept buckets and the bias, from all rows of the sample; their order does not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ratio = kept.value
        rows = sorted(row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if rows:
            w, b = _fit([np.searchsorted(best, np.frombuffer(x, "<i4")).astype(np.int32) for _, x in rows], np.array([y for y, _ in rows], float), ratio)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([b])], ["weights", "bias"])
        del rows
        trim()

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Weights by bucket (a table of 2^BITS floats) and bias, from labelled rows outside the held-out fold.

    Rows without id, label or text row are ignored; several labels of an id: the larger counts. With rows of fewer than
    two labels the model is the smoothed share of label 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    known = known.where(fold("id") != HELD_OUT).withColumn("h", F.xxhash64("id"))
    rows_of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    one, other = (known.where(F.col("toxic") == k).orderBy("h", "id").limit(SAMPLE) for k in (0, 1))
    picked = one.unionByName(other).select("id", "toxic")  # at most 2 * SAMPLE rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic").repartition(16)
    texts = texts.persist()
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        texts.unpersist()
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": float(np.log(share / (1 - share)))}
    counts = texts.mapInArrow(_counts, "block int, counts binary").groupBy("block")
    blocks = sorted(counts.applyInPandas(_significant(n), "block int, buckets binary, ratios binary").collect())
    best, ratio = (np.frombuffer(b"".join(r[k] for r in blocks), kind) for k, kind in (("buckets", "<i4"), ("ratios", "<f8")))
    kept = spark.sparkContext.broadcast((best, ratio))
    rows = texts.mapInArrow(_picked(kept), "toxic int, buckets binary").repartition(1)  # the sample, 2 * SAMPLE rows at most
    fitted = rows.mapInArrow(_fitted(kept), "weights binary, bias double").first()
    texts.unpersist()
    kept.destroy()
    prior = float(np.log(rows_of[1] / rows_of[0]) - np.log(min(SAMPLE, rows_of[1]) / min(SAMPLE, rows_of[0])))  # 0 where all rows are taken
    weights = np.zeros(1 << BITS, np.float32)
    weights[best] = np.frombuffer(fitted["weights"], "<f4")
    return {"weights": weights, "bias": fitted["bias"] + prior}


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, model: dict, text_col: str = "text", into: str = "_toxicity") -> DataFrame:
    """docs with a column ``into``: the score of each row's whole text, between 0 and 1. Null and empty texts: the
    score of a text without n-grams that count. Column names of docs may be anything but ``into``."""
    bounded_batches(docs.sparkSession)
    kept = np.flatnonzero(model["weights"]).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((kept, model["weights"][kept], model["bias"]))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        (kept, values, bias), weights = shared.value, np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        wanted = weights != 0
        for part in texts:
            z = np.array([weights[_present(t, wanted)].sum(dtype=np.float64) for t in part]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        trim()

    return docs.withColumn(into, of(F.col(f"`{text_col}`")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null doc_id is not held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, whatever these are called.

    Null and empty texts have the score of a text without n-grams that count, which is below the threshold unless most
    training rows are toxic. Rows with a null id are judged like others; repeated rows alike. An empty table: no rows.
    Labels without two classes among the training rows give every row the same score."""
    own = f"toxicity_{uuid.uuid4().hex}"
    return score(docs, train(docs, labels), into=own).where(F.col(own) < THRESHOLD).drop(own)
