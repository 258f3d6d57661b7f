"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Plan, with no cap anywhere. No step emits the pairs of a group: queries are sent to blocks of members. One task sorts
a whole short list:

1. One pass hashes every whole text into its shingle set, gives equal sets one node, and counts shingles in a
   mergeable table of counters (fixed number of buckets). Buckets over a threshold are *frequent*.
2. Every node lists its shingles in one global order, frequent ones last. Of n shingles a partner shares at least
   ceil(0.8 n), so it must also occur in one of the first n - ceil(0.8 n) + 1 lists: the short lists.
3. In each short list every node is compared with the list's first nodes only; components follow. Then the nodes of
   lists that hold several components ask the blocks with nodes of other components. Components therefore are those of
   all links.
4. Queries and members whose shingles are spread too differently over the ranges of the hash to reach the overlap with
   any other in the block go before their sets are fetched.
5. A block's inverted lists are built once, for all queries sent to it. A query is a T-occurrence search: its short
   lists are merged on a heap, the long ones probed by binary search for the members that remain (DivideSkip).

Sets are held as 64-bit hashes; two different shingles of a compared pair share one with a probability near
size^2 / 2^64.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import bounded_batches, discard, materialize, trim
from lonja.llm.graph import connected_components
from lonja.llm.shingles import shingle_sets

#: Jaccard threshold as a fraction of integers: 100 * intersection >= 80 * union.
SIMILARITY = (80, 100)
_BLOCK = 1 << 14
#: First nodes of a short list with which all its nodes are compared before components are formed.
PIVOTS = 4
#: Shingles of a block of members (8 bytes each; a longer set stands alone), and entries merged on a heap at most.
BLOCK_SHINGLES, HEAP = 1 << 17, 512


def need(n: int, num: int = SIMILARITY[0], den: int = SIMILARITY[1]) -> int:
    """Shingles of a set of n that any partner shares at least."""
    return -(-num * n // den)


def overlap_needed(a, b, num: int = SIMILARITY[0], den: int = SIMILARITY[1]):
    """T of a pair of sizes a and b: the least intersection with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def sketch_bits(n_chars: int) -> int:
    """Counter buckets as a power of two: about one for 32 shingles, 2^12 to 2^24 (a bitmap of 2 MB at most)."""
    return min(24, max(12, math.ceil(math.log2(max(n_chars, 1) / 6 / 32 + 1))))


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _spread(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 ranges of the hash (2,048 for sets of so many), in one, two or four bytes
    each."""
    bits = 11 if len(shingles) >= 1 << 11 else 8
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def _counts(spread: bytes) -> np.ndarray:
    return np.frombuffer(spread, (np.uint8, np.uint16, np.uint32)[{256: 0, 512: 1, 1024: 2, 2048: 0, 4096: 1, 8192: 2}[len(spread)]]).astype(np.int64)


def _common(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums of the ranges' smaller counts, in the narrow type of the others."""
    return np.minimum(others, np.minimum(own, np.iinfo(others.dtype).max).astype(others.dtype)).sum(1, dtype=np.int64)


def _possible(group: pd.DataFrame) -> pd.DataFrame:
    """The queries and members of a block that may link: the overlap of two sets is at most the sum of the ranges'
    smaller counts; of two large sets the fine ranges are compared as well."""
    sizes, spread = group["n"].to_numpy(), [_counts(x) for x in group["spread"]]
    asks, parts, keep = group["asks"].to_numpy(), group["component"].to_numpy(), np.zeros(len(group), bool)
    members = np.flatnonzero(~asks)
    members = members[np.argsort(sizes[members], kind="stable")]
    if len(members):
        coarse = [x.reshape(256, -1).sum(1) for x in spread]
        held = np.stack([coarse[k] for k in members])
        held = held.astype(np.uint8 if held.max() < 1 << 8 else np.uint32)
        begin = np.searchsorted(sizes[members], need(sizes), "left")
        end = np.searchsorted(sizes[members], sizes * SIMILARITY[1] // SIMILARITY[0], "right")
        for k in np.flatnonzero(asks):
            near = members[begin[k] : end[k]]
            wanted = overlap_needed(sizes[k], sizes[near])
            found = near[(_common(coarse[k], held[begin[k] : end[k]]) >= wanted) & (parts[near] != parts[k])]
            if len(spread[k]) > 256 and len(found):
                fits = [len(spread[m]) == 256 or np.minimum(spread[k], spread[m]).sum() >= overlap_needed(sizes[k], sizes[m]) for m in found]
                found = found[np.array(fits)]
            keep[found] = True
            keep[k] = len(found) > 0
    return group.loc[keep, ["block", "node", "component", "asks"]]


def _first_pass(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = np.zeros(1 << bits, np.uint16), np.uint64(64 - bits)
        for batch in batches:
            for part in _pieces(batch):
                sets = list(shingle_sets(part.column(1), n))
                sizes = [len(s) for s in sets]
                if sum(sizes):
                    found, times = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                    counts[found] = np.minimum(counts[found].astype(np.int64) + times, 65_535)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                    ["doc_id", "n_shingles", "node", "block", "counts"],
                )
        blocks = counts.reshape(-1, min(_BLOCK, len(counts)))
        full = [k for k in range(len(blocks)) if blocks[k].any()]
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(full, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in full], pa.binary())], ["doc_id", "n_shingles", "node", "block", "counts"]
        )

    return run


def _merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint16).astype(np.int64) for x in group["counts"])
    return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(np.minimum(total, 65_535).astype(np.uint16).tobytes(), 1)]})


def _frequent(sketches: DataFrame, bits: int, n_shingles: int) -> np.ndarray:
    """Bitmap of frequent buckets; its size is fixed by ``bits``. Counters merge in two levels, salted."""
    mean = n_shingles / (1 << bits)
    most = min(65_000, mean + 8 * math.sqrt(mean) + 48)

    def keep(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(zlib.decompress(_merge(key, group)["counts"][0]), np.uint16)
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(total > most, bitorder="little").tobytes()]})

    salted = sketches.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    merged = salted.groupBy("block", "salt").applyInPandas(_merge, "block int, counts binary")
    rows = merged.groupBy("block").applyInPandas(keep, "block int, bits binary").collect()
    out, size = np.zeros(max(1, (1 << bits) // 8), np.uint8), max(1, min(_BLOCK, 1 << bits) // 8)
    for row in rows:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _short_lists(n: int, bits: int, frequent):
    """The short lists' entries of each text: shingle, node, its size, and the shingle's place in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift = frequent.value, np.uint64(64 - bits)
        for batch in batches:
            for part in _pieces(batch):
                nodes, sizes, lists = [], [], [np.empty(0, np.uint64)]
                for s in shingle_sets(part.column(0), n):
                    if len(s):
                        bucket = s >> shift
                        late = (table[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        nodes.append(_node(s))
                        sizes.append(len(s))
                        lists.append(np.concatenate((s[~late], s[late]))[: len(s) - need(len(s)) + 1])
                lengths = [len(x) for x in lists[1:]]
                columns = np.concatenate(lists).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), np.concatenate([np.empty(0, np.int32), *(np.arange(k, dtype=np.int32) for k in lengths)])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "n", "pos"])
        trim()

    return run


def _spreads(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                sets = [s for s in shingle_sets(part.column(0), n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_spread(s) for s in sets], pa.binary())], ["node", "n", "spread"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                sets = [s for s in shingle_sets(part.column(0), n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


class Lists:
    """Inverted lists of a block of members, built once: the members (ascending) of every shingle of the block."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members], np.int64)
        flat = np.concatenate(members) if members else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, self.owners = flat[order], np.repeat(np.arange(len(members)), self.sizes)[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
        self.shingles, self.ends = flat[first], np.append(first, len(flat))

    def search(self, query: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Indices of the (allowed) members whose Jaccard similarity with the query reaches the threshold.

        T-occurrence search by DivideSkip: the query's lists are ordered by length and the L longest set aside. The
        others are merged, and a member must occur in T - L of them, where T is its required overlap. Only those that
        do are looked up in the long lists, by binary search, and only while they can still reach T."""
        none = np.empty(0, np.int64)
        if not len(query) or not len(self.sizes):
            return none
        required = overlap_needed(len(query), self.sizes)
        least = int(required.min())
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        if len(at) < least:
            return none
        at = at[np.argsort(self.ends[at + 1] - self.ends[at], kind="stable")]
        n_long = max(0, min(least - 1, int(least / (0.0085 * math.log(max(2, len(self.sizes))) + 1))))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        seen = _merged([self.owners[self.ends[k] : self.ends[k + 1]] for k in short], len(self.sizes))
        enough = seen >= np.maximum(1, required - n_long)
        candidates = np.flatnonzero(enough if allowed is None else enough & allowed)
        total = seen[candidates]
        for left, k in zip(range(n_long - 1, -1, -1), long[::-1]):
            if not len(candidates):
                return none
            x = self.owners[self.ends[k] : self.ends[k + 1]]
            total += x[np.minimum(np.searchsorted(x, candidates), len(x) - 1)] == candidates
            alive = total + left >= required[candidates]
            if not alive.all():
                candidates, total = candidates[alive], total[alive]
        return candidates[total >= required[candidates]]


def _merged(lists: list[np.ndarray], n: int) -> np.ndarray:
    """How many of the ascending lists hold each of n members: a merge on a heap; beyond HEAP entries a stable sort of
    the runs, which merges them too and is faster there."""
    seen = np.zeros(n, np.int64)
    if sum(map(len, lists)) > HEAP:
        found, times = np.unique(np.concatenate(lists), return_counts=True)
        seen[found] = times
        return seen
    for k, run in itertools.groupby(heapq.merge(*(x.tolist() for x in lists))):
        seen[k] = sum(1 for _ in run)
    return seen


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """All queries of a block against its members of other components."""
    asks = group[group["asks"]]
    members = group[~group["asks"]]
    lists, nodes, parts = Lists([np.frombuffer(x, np.uint64) for x in members["shingles"]]), members["node"].to_numpy(), members["component"].to_numpy()
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for query, component, shingles in zip(asks["node"], asks["component"], asks["shingles"]):
        hits = nodes[lists.search(np.frombuffer(shingles, np.uint64), parts != component)]
        src.append(np.full(len(hits), query, np.int64))
        dst.append(hits)
    return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def _blocks(homes: DataFrame) -> DataFrame:
    """(node, block) of nodes (node, n, home): nodes of one home come together in blocks of about BLOCK_SHINGLES; small
    homes share a block, large ones are dealt over several."""
    total = homes.agg(F.sum("n")).first()[0] or 0
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("parts"))
    return homes.join(parts, "home").select("node", F.pmod(F.xxhash64("home", salt), F.lit(-(-total // BLOCK_SHINGLES) or 1)).alias("block"))


def _among(docs: DataFrame, key: str, keys: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of docs whose key may be among keys: a bitmap filter of fixed size (2^bits bits, 2 MB), broadcast; it lets
    some others pass, which later steps drop, and no member is lost."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    bitmaps = keys.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap"))
    marked = docs.withColumn("_p", place).withColumn("bucket", F.expr("bitmap_bucket_number(_p)")).withColumn("_p", F.expr("bitmap_bit_position(_p)"))
    byte = F.conv(F.hex(F.substring("bitmap", F.expr("cast(_p div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("long")
    return marked.join(F.broadcast(bitmaps), "bucket").where((byte.bitwiseAND(F.expr("shiftleft(1L, cast(_p % 8 as int))"))) != 0).drop("bucket", "bitmap", "_p")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    Two rows link when 100 * intersection >= 80 * union of their sets of n-word shingles; component_id is the smallest
    id reachable by links. Null or empty texts and texts without words: n_shingles 0, component_id the row's own id.
    A null id: component_id null, linked with nothing. Repeated rows: each is returned. An empty table: no rows.
    Other columns of docs are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = sketch_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    passed = materialize(rows.mapInArrow(_first_pass(n, bits), "doc_id long, n_shingles long, node long, block int, counts binary"), "shingle-counts")
    ids = passed.where("block IS NULL").select("doc_id", "n_shingles", "node")
    total = ids.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_frequent(passed.where("block IS NOT NULL").select("block", "counts"), bits, total))
    # One text of each node; the few others that a bitmap lets pass fall to the distinct below.
    heads = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = _among(rows.where("doc_id IS NOT NULL"), "doc_id", heads.where("doc_id IS NOT NULL").select("doc_id")).select("text")
    postings = texts.mapInArrow(_short_lists(n, bits, frequent), "shingle long, node long, n int, pos int")
    of_list = Window.partitionBy("shingle")
    before = of_list.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.struct("node", "n", "pos")
    pivots = F.array(*(F.nth_value(entry, k).over(before) for k in range(1, PIVOTS + 1))).alias("pivots")
    ends = [f(F.col("node")).over(of_list).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    shared = postings.select("shingle", "node", "n", "pos", pivots, *ends).where("lo != hi").drop("lo", "hi").distinct()
    shared = materialize(shared, "short-lists")

    def may_link(a_n, b_n, a_pos, b_pos):
        """Sizes and places allow the required overlap if this is the first shingle the two share; if it is not, they
        meet in an earlier list."""
        t = F.ceil((a_n + b_n) * SIMILARITY[0] / sum(SIMILARITY))
        return (a_n * SIMILARITY[1] >= b_n * SIMILARITY[0]) & (b_n * SIMILARITY[1] >= a_n * SIMILARITY[0]) & (F.least(a_n - a_pos, b_n - b_pos) >= t)

    first = F.explode(F.filter("pivots", lambda p: p.isNotNull())).alias("first")
    stars = shared.select("node", "n", "pos", first).where((F.col("node") != F.col("first.node")) & may_link(F.col("first.n"), F.col("n"), F.col("first.pos"), F.col("pos")))
    stars = materialize(stars.select(F.col("first.node").alias("query"), F.col("node").alias("member")).distinct(), "star-candidates")

    def texts_of(nodes):
        """A text of each of these nodes, and a few others."""
        return _among(rows.where("doc_id IS NOT NULL"), "doc_id", heads.join(nodes, "node").select("doc_id")).select("text")

    spreads = texts_of(shared.select("node").distinct()).mapInArrow(_spreads(n), "node long, n long, spread binary")
    spreads = materialize(spreads.groupBy("node").agg(F.first("n").alias("n"), F.first("spread").alias("spread")), "spreads")

    def links_among(asks, blocks, name):
        """Links of queries with the members of blocks; only the texts that may link are hashed again."""
        both = asks.withColumn("asks", F.lit(True)).unionByName(blocks.withColumn("asks", F.lit(False))).join(spreads, "node")
        both = materialize(both.groupBy("block").applyInPandas(_possible, "block long, node long, component long, asks boolean"), name + "-ends")
        sets = texts_of(both.select("node").distinct()).mapInArrow(_sets(n), "node long, shingles binary")
        sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
        links = materialize(both.join(sets, "node").groupBy("block").applyInPandas(_search, "src long, dst long"), name)
        discard(both, sets)
        return links

    # Stars: a list's nodes are members, its first nodes the queries; a member's home is its smallest query.
    sizes = shared.groupBy("node").agg(F.first("n").alias("n"))
    homes = stars.groupBy(F.col("member").alias("node")).agg(F.min("query").alias("home")).join(sizes, "node")
    blocks = materialize(_blocks(homes).withColumn("component", F.col("node")), "star-blocks")
    asks = stars.join(blocks.withColumnRenamed("node", "member"), "member").select(F.col("query").alias("node"), F.col("query").alias("component"), "block").distinct()
    links = links_among(asks, blocks, "star-links")
    discard(stars, blocks)
    parts = connected_components(links)

    # Lists that still hold several components: their nodes are dealt into blocks, and a node asks a block in which one
    # of its lists has a node of another component whose size and place allow a link.
    placed = shared.join(parts, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("shingle")
    left = materialize(placed.join(mixed, "shingle", "left_semi"), "mixed-lists")
    homes = left.groupBy("node").agg(F.first("n").alias("n"), F.min("shingle").alias("home"))
    component = left.groupBy("node").agg(F.first("component").alias("component"))
    blocks = materialize(_blocks(homes).join(component, "node"), "mixed-blocks")
    held = left.join(blocks.select("node", "block"), "node").groupBy("shingle", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    t = F.ceil((F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * SIMILARITY[0] / SIMILARITY[1]))) * SIMILARITY[0] / sum(SIMILARITY))
    sizes_fit = (F.col("most") * SIMILARITY[1] >= F.col("n") * SIMILARITY[0]) & (F.col("n") * SIMILARITY[1] >= F.col("least") * SIMILARITY[0])
    other = (F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component"))
    asks = left.join(held, "shingle").where(other & sizes_fit & (F.least(F.col("n") - F.col("pos"), F.col("rest")) >= t))
    more = links_among(asks.select("node", "component", "block").distinct(), blocks, "mixed-links")
    discard(blocks, left, shared)
    parts = connected_components(links.unionByName(more))

    placed = ids.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    heads = placed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("head"))
    out = placed.join(heads, "part", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("node").isNotNull(), F.col("head")), "doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
