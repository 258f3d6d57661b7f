"""Spelling variants: words one edit apart by a dictionary of pairs of trie nodes, grouped under their most frequent form.

The nodes of the trie of all words and of the trie of all reversed words get integer numbers. A word of length L is
prefix + suffix at L + 1 places, each a pair (prefix node, suffix node), and prefix + one character + suffix at L places.
Two words differ by one replaced character exactly when they share a pair around a skipped character, and by one deleted or
inserted character exactly when the pair around a skipped character of the longer one is a whole pair of the shorter
one; of a run of equal characters only the first one's skip counts, so each two words meet once. A meeting has at most one
whole word and one word for each character of the alphabet, however many words there are.

Tries are numbered without building them: in sorted order a word opens the nodes beyond the prefix that it shares with the
word before. The order is cut into ranges; the prefixes that run across a cut are numbered by the first cut they cross,
so only one prefix and two lengths for each range are sent to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lonja.llm.common import bounded_batches, discard, materialize

#: Least code points and occurrences of a word, and how many times more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Characters of words (A-Z are lower-cased before).
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Bits of a node's number below the range's, and the bit that marks prefixes across a cut.
_RANGE_BITS, _CROSSING = 40, 1 << 39


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts of at least ``least_length`` code points that occur ``least_count``
    times or more. Null texts have no words. With ``slips``, a run whose crc32 of ``<id>:<run>`` is a multiple of it loses
    the code point at that crc32 modulo its length (made-up misspellings; none where the id is null)."""
    bounded_batches(docs.sparkSession)
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                runs = Counter(run.findall((text.as_py() or "").encode().lower().decode()))
                if slips and key.is_valid:
                    start = zlib.crc32(f"{key.as_py()}:".encode())
                    for word in list(runs):
                        if (h := zlib.crc32(word.encode(), start)) % slips == 0:
                            at, n = h % len(word), runs.pop(word)
                            if len(word) > least_length:
                                held[word[:at] + word[at + 1 :]] += n
                held.update(runs)
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    return lo


class Cuts:
    """Where the sorted words are cut: for each range its number, the length of the prefix that all its words share, and the
    prefix that its first word shares with the last word of the range before (empty for the first range)."""

    def __init__(self, rows: list):
        self.place = {row["part"]: k for k, row in enumerate(rows)}
        self.inner = [row["inner"] for row in rows]
        self.shared = [row["shared"] for row in rows]

    def crossing(self, k: int) -> np.ndarray:
        """Numbers of the prefixes of every length that run across cut k: the first cut that each of them crosses."""
        depth = np.arange(len(self.shared[k]) + 1, dtype=np.int64)
        first, m = np.full(len(depth), k, np.int64), len(depth) - 1
        while k and m:
            k -= 1
            m = min(m, self.inner[k], len(self.shared[k]))
            first[: m + 1] = k
        out = (first << _RANGE_BITS) | _CROSSING | depth
        out[0] = 0  # the root
        return out


def _cuts(ranges: DataFrame) -> Cuts:
    """One row for each range; its words stay on the executors, but for the prefix shared across a cut."""
    prefix = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: x[: common_prefix(x, y)] if x is not None and y is not None else ""), "string")
    ends = ranges.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))
    ends = ends.withColumn("before", before).select("part", F.length(prefix("first", "last")).alias("inner"), prefix("first", "before").alias("shared"))
    return Cuts(ends.orderBy("part").collect())


def trie_nodes(words: DataFrame, key: str | None = None) -> DataFrame:
    """``words`` (word, distinct and not null, and other columns) with number (long, in the order of words), nodes (the trie node
    of each prefix, root first) and fresh (for each character: unlike the one before). With ``key`` only that column of
    ``words`` and nodes."""
    order = words.repartitionByRange("word").withColumn("part", F.spark_partition_id())
    ranges = materialize(order, "word-ranges")
    cuts = _cuts(ranges)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, opened, row = None, "", 0, 0
        path, crossing, ahead = np.zeros(1, np.int64), np.zeros(1, np.int64), ""
        for batch in batches:
            numbers, nodes, fresh = [], [], []
            for own, word in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist()):
                if own != part:
                    part, opened, row, k = own, 0, 0, cuts.place[own]
                    path, shared = cuts.crossing(k), len(cuts.shared[k])
                    ahead, crossing = (cuts.shared[k + 1], cuts.crossing(k + 1)) if k + 1 < len(cuts.shared) else ("", np.zeros(1, np.int64))
                else:
                    shared = common_prefix(before, word)
                new = np.arange(opened + 1, opened + 1 + len(word) - shared, dtype=np.int64) | (k << _RANGE_BITS)
                opened += len(new)
                path = np.concatenate((path[: shared + 1], new))
                if (onward := common_prefix(word, ahead)) > shared:  # prefixes that the next range goes on with
                    path[shared + 1 : onward + 1] = crossing[shared + 1 : onward + 1]
                numbers.append(k << _RANGE_BITS | row)
                nodes.append(path)
                fresh.append([a != b for a, b in zip(word, "\0" + word)])
                before, row = word, row + 1
            columns = {"number": pa.array(numbers, pa.int64()), "nodes": pa.array(nodes, pa.list_(pa.int64())), "fresh": pa.array(fresh, pa.list_(pa.bool_()))}
            columns |= {f.name: batch.column(f.name) for f in batch.schema if f.name != "part"}
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept], kept)

    fields = {"number": "bigint", "nodes": "array<bigint>", "fresh": "array<boolean>"} | {f.name: f.dataType.simpleString() for f in words.schema.fields}
    kept = [key, "nodes"] if key else list(fields)
    rows = ranges.repartition("part").sortWithinPartitions("part", "word")
    out = materialize(rows.mapInArrow(number, ", ".join(f"`{c}` {fields[c]}" for c in kept)), "trie-nodes")
    discard(ranges)
    return out


def numbered_words(words: DataFrame) -> DataFrame:
    """(number, word, n, prefixes, suffixes, fresh) from distinct (word, n): the nodes of all prefixes and of all suffixes by
    their length. Stored."""
    forward = trie_nodes(words.select("word", "n"))
    backward = trie_nodes(forward.select(F.reverse("word").alias("word"), "number"), key="number")
    both = forward.withColumnRenamed("nodes", "prefixes").join(backward.withColumnRenamed("nodes", "suffixes"), "number")
    out = materialize(both, "numbered-words")
    discard(forward, backward)
    return out


_PAIRS = """inline(concat(
  transform(sequence(1, length(word)), i -> named_struct('prefix', prefixes[i - 1], 'suffix', suffixes[length(word) - i], 'whole', false, 'fresh', fresh[i - 1])),
  transform(sequence(0, length(word)), i -> named_struct('prefix', prefixes[i], 'suffix', suffixes[length(word) - i], 'whole', true, 'fresh', true))))"""
#: Others of a meeting that are near to one of its words.
_OTHERS = "filter(met, b -> b.number != a.number AND (NOT a.whole AND NOT b.whole OR a.fresh AND b.fresh))"


def _meetings(nodes: DataFrame) -> DataFrame:
    """One row for each pair of nodes that two words or more have: met, the words there (at most one for each character of the
    alphabet and the one without it)."""
    pairs = nodes.selectExpr("number", "n", _PAIRS)
    return pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("number", "n", "whole", "fresh")).alias("met")).where("size(met) > 1").select("met")


#: The counterpart in DuckDB: crc32 byte by byte, words around a skipped character, forms followed one by one.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run FROM documents),
r AS (SELECT run, doc_id || ':' || run AS said, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(strlen(said)), lambda i: ('0x' || substr(hex(said), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
v AS (SELECT word, n FROM w WHERE length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
d AS (SELECT DISTINCT k.word AS a, v.word AS b FROM k JOIN v ON v.word = k.p || k.s),
e AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word UNION ALL SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
o AS (SELECT e.a, e.b, v.n, row_number() OVER (PARTITION BY e.a ORDER BY v.n DESC, e.b) AS rank, count(*) OVER (PARTITION BY e.a) AS n_near FROM e JOIN v ON v.word = e.b),
f AS (SELECT v.word, CASE WHEN o.n >= {RATIO} * v.n THEN o.b END AS form, v.n, coalesce(o.n_near, 0)::BIGINT AS n_near, CASE WHEN o.n >= {RATIO} * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON o.a = v.word AND o.rank = 1),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM g JOIN f ON f.form = g.word)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word)
"""


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(number, near): all pairs of words one edit apart, once in either direction, from numbered_words()."""
    return _meetings(nodes).selectExpr(f"inline(flatten(transform(met, a -> transform({_OTHERS}, b -> named_struct('number', a.number, 'near', b.number)))))")


def _roots(forms: DataFrame) -> DataFrame:
    """(number, root) from (number, form): each form's form is followed by doubling. Counts rise by RATIO with each form,
    so chains are at most log(greatest count) long, and rounds the logarithm of that."""
    now = materialize(forms.select("number", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("number").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(onward, "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row for each word of distinct (word, n): form (its near word of greatest n, ties to the first in code-point order, if
    that n is at least ``ratio`` (above 1) times its own), root (form after form to the last; itself without one), n, n_near (words one
    edit apart) and form_n. An empty table gives an empty table."""
    nodes = numbered_words(words)
    near = _meetings(nodes).selectExpr(f"inline(transform(met, a -> named_struct('number', a.number, 'near', {_OTHERS})))").where("size(near) > 0")
    best = "array_max(transform(near, b -> named_struct('n', b.n, 'back', -b.number)))"
    near = near.selectExpr("number", "size(near) AS n_near", f"{best} AS best").groupBy("number").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    near = nodes.select("number", "word", "n").join(near, "number", "left").withColumn("has_form", F.col("best.n") >= F.lit(ratio) * F.col("n"))
    near = materialize(near.select("number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("has_form"), -F.col("best.back")).alias("form"), F.when(F.col("has_form"), F.col("best.n")).alias("form_n")), "near-words")
    discard(nodes)
    roots = _roots(near.where("form IS NOT NULL").select("number", "form"))
    names = near.select(F.col("number").alias("other"), F.col("word").alias("name"))
    named = near.where("form IS NOT NULL").select("number", "form").join(roots, "number")
    named = named.join(names.toDF("form", "form_word"), "form").join(names.toDF("root", "root_word"), "root").select("number", "form_word", "root_word")
    out = near.drop("form").join(named, "number", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
