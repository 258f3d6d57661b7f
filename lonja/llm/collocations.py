"""Phrase collocations: word pairs counted in tiles of frequency-ranked ids, frequent pairs ranked anew and extended.

Texts are cut into chunks, and each distinct word of a chunk is joined once with the table of frequent words, which are
numbered by language and falling frequency. A chunk's adjacent pairs fall into square tiles of ids: a tile with many pairs
is counted in a dense array by bincount, all sparse ones together as one sorted list of coordinates. Counts of chunks are
summed by Spark, so a pair has one row for each chunk, however frequent. Frequent pairs are numbered by falling frequency like words, and a
phrase of three words is a pair of such a pair and a word, counted in tiles the same way.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bounded_batches, discard, materialize, trim
from lonja.llm.ranks import ranked

#: Least occurrences of a phrase, phrases returned for a language, and the share (in hundredths) of a phrase's places
#: within a longer one from which it is dropped.
LEAST, TOP, WITHIN = 10, 2000, 50
#: Language of texts without one.
NO_LANG = "und"
#: Bytes of text in a chunk, bytes whose words are cut at a time, positions of a stored row, rows of a batch.
CHUNK, PIECE, SEGMENT, ROWS = 16 << 20, 1 << 20, 1 << 17, 1 << 18
#: Ids on a tile's side, and pairs of a chunk from which a tile is dense.
TILE = 1024
DENSE = TILE * TILE // 16

#: A-Z to a-z, tabs to spaces, characters that end a piece to a full stop.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Rows of all steps: words of a chunk (a: number in the chunk), its text as numbers (a: segment), counts of pairs (a, b).
_ROW = "chunk bigint, lang string, kind string, a bigint, b bigint, n bigint, word string, ids binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("ids", pa.binary())])


def _batches(chunk: int, lang: str, kind: str, **columns) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for at in range(0, size, ROWS):
        end = min(size, at + ROWS)
        own = {"chunk": pa.array(np.full(end - at, chunk, np.int64)), "lang": pa.repeat(lang, end - at), "kind": pa.repeat(kind, end - at)}
        own |= {c: pa.array(v[at:end], _ARROW.field(c).type) for c, v in columns.items()}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(end - at, f.type) for f in _ARROW], schema=_ARROW)


def _segments(chunk: int, lang: str, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = [numbers[at : at + SEGMENT].tobytes() for at in range(0, len(numbers), SEGMENT)]
    yield from _batches(chunk, lang, "text", a=np.arange(len(parts)), ids=parts) if parts else ()


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a cleaned text, cut at spaces; a longer word stands in a part of its own."""
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.rfind(b" ", at, at + PIECE)
        if end <= at:
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


def _without_runs(numbers: np.ndarray, gap: int) -> np.ndarray:
    keep = np.ones(len(numbers), bool)
    keep[1:] = (numbers[1:] != gap) | (numbers[:-1] != gap)
    return numbers[keep]


def _cut(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts: their distinct words with counts, and the texts as numbers of words, 0 where a piece ends."""
    chunk, size, held = TaskContext.get().partitionId() << 32, 0, {}

    def flush():
        for lang, (numbers, text) in held.items():
            coded = np.frombuffer(text, np.int32)
            counts = np.bincount(coded, minlength=len(numbers))
            if len(numbers) > 1:
                words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
                yield from _batches(chunk, lang, "word", a=np.arange(1, len(numbers)), n=counts[1:], word=words)
                yield from _segments(chunk, lang, _without_runs(coded, 0).astype(np.int64))

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            data = (text.as_py() or "").encode().translate(_CLEAN)
            key = lang.as_py() if lang.is_valid else NO_LANG
            if key not in held:
                numbers: defaultdict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                held[key] = numbers, array("i", [numbers[b"."]])
            numbers, coded = held[key]
            for piece in _pieces(data):
                coded.extend(map(numbers.__getitem__, piece.replace(b".", b" . ").split()))
            coded.append(0)
            size += len(data)
            if size >= chunk_bytes:
                yield from flush()
                chunk, size = chunk + 1, 0
                held.clear()
                trim()
    yield from flush()


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks (int64, below 2^31) and their counts. Pairs are dealt to tiles of TILE x TILE ranks; tiles of
    DENSE pairs or more are counted by address, the pairs of all others by sorting their coordinates."""
    if not len(left):
        return left, right, np.empty(0, np.int64)
    wide = int(right.max()) // TILE + 1
    tile = left // TILE * wide + right // TILE
    tiles, where, size = np.unique(tile, return_inverse=True, return_counts=True)
    dense = size[where] >= DENSE
    keys, counts = np.unique(left[~dense] << 32 | right[~dense], return_counts=True)
    found = [(keys >> 32, keys & 0xFFFFFFFF, counts)]
    inside, own = np.flatnonzero(dense), where[dense]
    inside = inside[np.argsort(own, kind="stable")]
    at = 0
    for t in np.flatnonzero(size >= DENSE):
        pairs, at = inside[at : at + size[t]], at + size[t]
        table = np.bincount(left[pairs] % TILE * TILE + right[pairs] % TILE, minlength=TILE * TILE)
        cells = np.flatnonzero(table)
        found.append((tiles[t] // wide * TILE + cells // TILE, tiles[t] % wide * TILE + cells % TILE, table[cells]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _text(table: pa.Table) -> np.ndarray:
    """A chunk's text: its segments in order."""
    parts = sorted(zip(table.column("a").to_pylist(), table.column("ids").to_pylist()))
    return np.concatenate([np.frombuffer(p, np.int64) for _, p in parts]) if parts else np.empty(0, np.int64)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    trim()
    return pa.Table.from_batches(list(batches), _ARROW)


def _word_pairs(key: tuple, text: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk with ids for its frequent words and -1 for all else, and the counts of its adjacent pairs of them."""
    chunk, lang = key[0].as_py(), key[1].as_py()
    numbers, coded = _text(text), _column(words, "id")
    order = np.sort(coded)
    rank = np.full(max(numbers.max(initial=0), _column(words, "a").max(initial=0)) + 1, -1, np.int64)
    rank[_column(words, "a")] = np.searchsorted(order, coded)
    local = _without_runs(rank[numbers], -1)
    both = (local[:-1] >= 0) & (local[1:] >= 0)
    left, right, n = tile_counts(local[:-1][both], local[1:][both])
    ids = np.append(order, -1)

    def rows():
        yield from _segments(chunk, lang, ids[local])
        yield from _batches(chunk, lang, "pair", a=order[left], b=order[right], n=n) if len(n) else ()

    return _table(rows())


def _triples(key: tuple, text: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a chunk's frequent pairs with the word that follows them, where the two last words are a frequent pair too."""
    ids, local = np.unique(np.append(_text(text), -1), return_inverse=True)
    local = local[:-1].astype(np.int64)  # 0 stands for no frequent word
    coded = _column(pairs, "id")
    key_of = np.searchsorted(ids, _column(pairs, "a")) << 32 | np.searchsorted(ids, _column(pairs, "b"))
    by_key, order = np.argsort(key_of), np.sort(coded)
    keys, ranks = key_of[by_key], np.searchsorted(order, coded[by_key])
    here = local[:-1] << 32 | local[1:]
    at = np.minimum(np.searchsorted(keys, here), max(len(keys) - 1, 0))
    pair = np.where(keys[at] == here, ranks[at], -1) if len(keys) else np.full(len(here), -1, np.int64)
    both = (pair[:-1] >= 0) & (pair[1:] >= 0)
    left, right, n = tile_counts(pair[:-1][both], local[2:][both])
    return _table(_batches(key[0].as_py(), key[1].as_py(), "pair", a=order[left], b=ids[right], n=n) if len(n) else ())


def _summed(pairs: DataFrame, least: int) -> DataFrame:
    """Counts of all chunks by hash; ids belong to one language, which is joined to the few that are left."""
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, chunk_bytes: int = CHUNK) -> dict[str, DataFrame]:
    """Stored tables of the counts of whole texts, by language: totals (lang, n), and with ``least`` occurrences or more words (id,
    lang, word, n), pairs (id, lang, a, b, n; a and b are word ids) and triples (a: pair id, b: word id, n, lang).

    Null texts have no words, null languages count as NO_LANG. Repeated rows count each; other columns are not read."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = materialize(texts.mapInArrow(partial(_cut, chunk_bytes=chunk_bytes), _ROW), "chunks")
    said = cut.where("kind = 'word'")
    totals = materialize(said.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = said.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = materialize(ranked(words, [], [F.asc("lang"), F.desc("n"), F.asc("word")], "id"), "words")
    # One row for each distinct word of a chunk: a word has as many rows as there are chunks with it.
    numbered = said.select("chunk", "lang", "a", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "lang", "a", "id")
    text = cut.where("kind = 'text'").select("chunk", "lang", "a", "ids").toDF("chunk", "lang", "a", "ids")
    coded = materialize(text.groupBy("chunk", "lang").cogroup(numbered.groupBy("chunk", "lang")).applyInArrow(_word_pairs, _ROW), "coded")
    discard(cut)
    counted = coded.where("kind = 'pair'").select("chunk", "lang", "a", "b", "n")
    spoken = words.select(F.col("id").alias("a"), "lang")
    pairs = materialize(ranked(_summed(counted, least).join(spoken, "a"), [], [F.asc("lang"), F.desc("n"), F.asc("a"), F.asc("b")], "id"), "pairs")
    numbered = counted.select("chunk", "lang", "a", "b").join(pairs.select("a", "b", "id"), ["a", "b"]).select("chunk", "lang", "a", "b", "id")
    text = coded.where("kind = 'text'").select("chunk", "lang", "a", "ids").toDF("chunk", "lang", "a", "ids")
    triples = text.groupBy("chunk", "lang").cogroup(numbered.groupBy("chunk", "lang")).applyInArrow(_triples, _ROW)
    triples = _summed(triples.select("a", "b", "n"), least).join(pairs.select(F.col("id").alias("a"), "lang"), "a")
    triples = materialize(triples, "triples")
    discard(coded)
    return {"totals": totals, "words": words, "pairs": pairs, "triples": triples}


#: floor(1000000 * a * a / (l * r)) with 38 digits; at most 1,000,000, since neither part is rarer than the phrase.
_SCORE = "CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, within: int = WITHIN, chunk_bytes: int = CHUNK) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: lang, rank, phrase, a (its occurrences), l and r (those of
    the parts of its lowest-scoring cut), n (words of the language) and score. Phrases with ``within`` hundredths of their
    occurrences or more inside one longer phrase are left out. A table without words gives an empty table."""
    t = phrase_counts(docs, text_col, lang_col, least, chunk_bytes)
    words, pairs = t["words"].select("id", "word", F.col("n").alias("f")), t["pairs"].withColumnRenamed("n", "f")
    first, last = words.toDF("a", "first", "l"), words.toDF("b", "last", "r")
    two = pairs.join(first, "a").join(last, "b")
    two = materialize(two.select("id", "lang", "a", "b", F.concat_ws(" ", "first", "last").alias("phrase"), "f", "l", "r"), "two-words")
    # A triple's first pair is its own row's; its last pair is found by both of its words.
    three = t["triples"].select("lang", F.col("a").alias("head"), F.col("b").alias("last_id"), F.col("n").alias("f3"))
    heads = two.select(F.col("id").alias("head"), F.col("b").alias("middle_id"), F.col("phrase").alias("head_phrase"), F.col("f").alias("f_head"), F.col("l").alias("f_first"))
    tails = two.select(F.col("id").alias("tail"), F.col("a").alias("middle_id"), F.col("b").alias("last_id"), F.col("f").alias("f_tail"), F.col("r").alias("f_last"))
    three = three.join(heads, "head").join(tails, ["middle_id", "last_id"]).join(words.select(F.col("id").alias("last_id"), F.col("word").alias("last")), "last_id")
    three = materialize(three.select("lang", "head", "tail", F.concat_ws(" ", "head_phrase", "last").alias("phrase"), "f3", "f_head", "f_first", "f_tail", "f_last"), "three-words")
    longer = three.select(F.col("head").alias("id"), "f3").unionByName(three.select(F.col("tail").alias("id"), "f3")).groupBy("id").agg(F.max("f3").alias("longer"))
    two = two.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("f")))
    two = two.select("lang", "phrase", F.col("f").alias("a"), "l", "r").withColumn("score", F.expr(_SCORE))
    cuts = three.selectExpr("lang", "phrase", "f3 AS a", "inline(array(named_struct('k', 1, 'l', f_first, 'r', f_tail), named_struct('k', 2, 'l', f_head, 'r', f_last)))")
    cuts = cuts.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    found = two.unionByName(cuts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = ranked(found, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], most=top)
    return best.join(t["totals"], "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The counterpart in DuckDB: all phrases of one to three words counted as strings.
ORACLE_SQL = f"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w WHERE len(w) > 2),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
cut AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (VALUES (1), (2)) v(k) WHERE k < len(w)),
s AS (SELECT cut.lang, cut.phrase, w, a, cut.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT o.lang, o.phrase FROM o JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM o WHERE len(w) = 3) b ON b.lang = o.lang AND b.part = o.phrase WHERE 100 * b.a >= {WITHIN} * o.a),
z AS (SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank FROM o ANTI JOIN i ON i.lang = o.lang AND i.phrase = o.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= {TOP}
"""
