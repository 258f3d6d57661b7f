"""Mixing sources to target weights.

Documents of a source are packed, word after word, into blocks of a fixed length. A source's target gives the number of
its slots; its slots are spread over the output shards by a multinomial draw (given the totals of the sources, the
multinomial counts of the shards are those). Slot j of a source takes block p_e(j mod B) of its B blocks, p_e a
pseudorandom permutation for the pass e = j div B; slots and blocks join by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lonja.llm.common import bounded_batches, materialize, trim, words

#: Weights in turn, share of all words that is asked for, most passes over a source, words of a block, output shards.
WEIGHTS, SHARE, MOST, BLOCK, SHARDS = (5, 2, 1), 1.5, 2, 64, 64
#: Documents of a source are dealt into so many packing streams at least, and more when documents grow in number.
STREAMS, DOCS_PER_STREAM = 64, 20_000
#: Slots of an output shard at most, in the mean: more words make more shards.
SLOTS_PER_SHARD = 500_000


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a four-round Feistel network over the next even power of
    two, walked on until the value is in range."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = x >> half[at], x & mask[at]
        for k in range(4):
            h = (right + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ key[at]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[at])
        return (left << half[at]) | right

    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x[todo] = once(x[todo], todo)
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code-point order, null last, have weights 5, 2, 1 in turn. They share SHARE of all words by weight; a
    target stops at MOST times its source's size and the excess is shared anew. The level (words for each unit of
    weight) rises until no further source stops: a few sums, of which only the scalars reach the driver."""
    # Ranks of any number of names: places in ranges of the order, plus the sizes of the ranges before (one row each).
    order = F.col("source").asc_nulls_last()
    ranges = materialize(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "source-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    sizes = ranges.join(offsets, "part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = materialize(sizes.withColumn("weight", weight.cast("double")).select("source", "source_size", "weight"), "source-sizes")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        full = F.col("source_size") * MOST <= F.col("weight") * level
        row = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size") * MOST)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if row["n"] == stopped or not row["weights"]:
            break
        stopped, level = row["n"], (SHARE * total - (row["taken"] or 0)) / row["weights"]
    return rows.select("source", "source_size", F.least(F.col("source_size") * float(MOST), F.col("weight") * level).alias("target"))


def _draw(seed: int, shards: int):
    def run(frames):
        """Slots of a source in each shard: a multinomial draw of its total, seeded by the source."""
        for pdf in frames:
            out = []
            for source, n, blocks, h in zip(pdf["source_key"], pdf["slots"], pdf["blocks"], pdf["h"]):
                counts = np.random.default_rng([seed, int(h) & 0xFFFFFFFF, (int(h) >> 32) & 0xFFFFFFFF]).multinomial(int(n), np.full(shards, 1 / shards))
                begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
                out.append(pd.DataFrame({"source_key": source, "h": h, "blocks": blocks, "shard": np.arange(shards), "first": begin, "count": counts}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("source_key", "h", "blocks", "shard", "first", "count")})

    return run


@F.pandas_udf(LongType())
def _block_of(slot: pd.Series, blocks: pd.Series, h: pd.Series) -> pd.Series:
    n, j = blocks.to_numpy(), slot.to_numpy()
    key = h.to_numpy().view(np.uint64) + (j // n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return pd.Series(permuted(j % n, n, key))


def row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row, except maps, which have no order."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *reversed(columns)).alias("b"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, shards: int = SHARDS) -> dict[str, DataFrame]:
    """Tables of a mix: ``documents`` (doc_id, size, source_size, target, taken), ``pieces`` (doc_id, row_key, begin,
    length, times: words begin..begin+length of the document, taken so often) and ``slots`` (source_key, shard, slot,
    block), the contents of the shards.

    Null and empty texts have size 0 and take 0. Null sources are one source, the last. Repeated rows are documents of
    their own; rows with a null id take part. An empty table: no rows. Other columns only order rows that are equal in id
    and text. Equal inputs give equal results: streams are ordered by id and text, draws and permutations are seeded by
    the source."""
    bounded_batches(docs.sparkSession)
    named = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(named[0].alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.size(words(named[1])).cast("long").alias("size"), F.xxhash64(*named).alias("order_key"), row_key(docs).alias("row_key"))
    # A null source and a source named like the key of null stay apart: the key has a prefix.
    rows = materialize(rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "document-sizes")
    return _mixed(rows, seed, shards)


def _mixed(rows: DataFrame, seed: int, shards: int) -> dict[str, DataFrame]:
    spark = rows.sparkSession
    streams = max(STREAMS, -(-rows.count() // DOCS_PER_STREAM))
    rows = rows.withColumn("stream", F.pmod(F.xxhash64("order_key", F.lit(seed)), F.lit(streams)).cast("int"))
    wanted = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "source-targets")
    total = wanted.agg(F.sum("source_size")).first()[0] or 0
    shards = max(shards, -(-int(total * SHARE) // (BLOCK * SLOTS_PER_SHARD)))
    of_stream = Window.partitionBy("source_key", "stream").orderBy("doc_id", "order_key", "row_key")
    begin = F.sum("size").over(of_stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    tie = F.row_number().over(of_stream)
    packed = rows.where("size > 0").withColumn("begin", begin).withColumn("tie", tie)
    packed = packed.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {BLOCK}"), F.expr(f"(begin + size - 1) div {BLOCK}"))))
    start = F.greatest(F.col("begin"), F.col("block") * BLOCK)
    packed = packed.withColumn("from", start - F.col("begin")).withColumn("length", F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BLOCK) - start)
    ends = rows.groupBy("source_key", "stream").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("n"))
    through = Window.partitionBy("source_key").orderBy("stream").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("base", F.sum("n").over(through) - F.col("n"))  # one row per source and stream
    ends = materialize(ends, "stream-blocks")
    blocks = ends.groupBy("source_key").agg(F.sum("n").alias("blocks")).where("blocks > 0")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key")
    plan = wanted.select(key, "source_size", "target").join(blocks, "source_key")
    slots = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + F.lit(0.5))
    plan = plan.select("source_key", F.least(slots, F.col("blocks") * MOST).cast("long").alias("slots"), "blocks", F.xxhash64("source_key", F.lit(seed)).alias("h"))
    drawn = plan.repartition("source_key").mapInPandas(_draw(seed, shards), "source_key string, h long, blocks long, shard int, first long, count long").where("count > 0")
    # A fixed number of partitions: few rows, each of which unfolds into many.
    drawn = drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_key", "shard")
    slot = drawn.select("source_key", "shard", "blocks", "h", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
    slot = slot.select("source_key", "shard", "slot", _block_of("slot", "blocks", "h").alias("block"))
    times = slot.groupBy("source_key", "block").agg(F.count("*").alias("times"))
    packed = packed.join(ends.select("source_key", "stream", "base"), ["source_key", "stream"]).withColumn("block", F.col("block") + F.col("base"))
    # Spark takes tables that unfold from few rows for small ones: these joins are by merge, whatever it estimates.
    pieces = packed.join(times.hint("merge"), ["source_key", "block"]).select("doc_id", "row_key", "source_key", "stream", "tie", F.col("from").alias("begin"), "length", "times")
    taken = pieces.groupBy("source_key", "stream", "tie").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    numbered = rows.where("size > 0").withColumn("tie", tie).unionByName(rows.where("size = 0").withColumn("tie", F.lit(None).cast("int")))
    documents = numbered.join(taken.hint("merge"), ["source_key", "stream", "tie"], "left").join(wanted.select(key, "source_size", "target"), "source_key")
    documents = documents.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return {"documents": documents, "pieces": pieces, "slots": slot, "targets": wanted}


def _cut(frames):
    """Texts of the taken words, pass by pass, with the white space between neighbouring words as it was."""
    import re

    trim()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for pdf in frames:
        texts = []
        for text, ranges in zip(pdf["text"], pdf["ranges"]):
            spans = [m.span() for m in word.finditer(text)]
            parts, last = [], None
            for begin, length in sorted((int(r["begin"]), int(r["length"])) for r in ranges):
                a, b = spans[begin][0], spans[begin + length - 1][1]
                if last is not None and last[1] == begin:
                    parts[-1] = (parts[-1][0], b)
                else:
                    parts.append((a, b))
                last = (begin, begin + length)
            texts.append("\n".join(text[a:b] for a, b in parts))
        yield pdf.drop(columns=["ranges"]).assign(text=texts)
    trim()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents with the columns of docs, whatever these are called: a document has a row for each pass that
    takes words of it, whose text is those words; ``chars_col``, if there, is their length.

    Null and empty texts take no words and give no row; rows with a null id or source take part like others. Repeated
    rows each take their own words; rows that differ in any column but maps keep their own columns. An empty table: no
    rows."""
    rest = [c for c in docs.columns if c != text_col]
    pieces = mix(docs, id_col, text_col, source_col)["pieces"]
    passes = pieces.select("row_key", "tie", F.struct("begin", "length").alias("r"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass"))
    ranges = passes.groupBy("row_key", "tie", "pass").agg(F.collect_list("r").alias("ranges")).select("row_key", "ranges")
    # Rows are held in one struct, so that their names meet no others. Rows equal in all columns share it; each of them
    # has ranges of its own.
    held = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(None).alias("none"))
    copies = docs.select(row_key(docs).alias("row_key"), held.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")).dropDuplicates(["row_key"])
    joined = copies.join(ranges.hint("merge"), "row_key").select("row", "text", "ranges")
    schema = StructType([joined.schema["row"], joined.schema["text"]])
    cut = joined.mapInPandas(_cut, schema)

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        if c == chars_col:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("row")[c].alias(c)

    return cut.select(*map(column, docs.columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs."""
    return mix(docs)["documents"]
