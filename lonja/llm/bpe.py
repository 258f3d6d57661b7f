"""BPE encoding and decoding over a distinct-word table.

1. Every task splits the words of its texts once and packs them, chunk by chunk (a bounded number of words), into a
   word list and, for each document, the positions of its words in that list. Chunks are stored as a bucketed table in
   the shared folder.
2. The words of all chunks meet in one exchange by word and are sorted: the runs of equal words are the distinct-word
   table. Each distinct word is encoded once, and every (chunk, position) that has it takes its ids.
3. The ids return to their chunks by (chunk, position), packed; documents are put together there, and decoded by joining their
   ids with the id-to-piece table, which is shipped to the tasks. The stored side is bucketed by chunk and is not
   shuffled again.

The tokenizer is a file of the ``tokenizers`` library: NFC, white-space replacement, lower case, split by a pattern,
BPE over bytes. Its text is shipped to the tasks (a vocabulary has a fixed size).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bounded_batches, drop_at_end, scratch, trim

#: Words and distinct words of a chunk at most, and text bytes of one output batch (a longer text stands alone).
CHUNK_WORDS, CHUNK_DISTINCT, BATCH_BYTES = 3_000_000, 350_000, 4 << 20
#: Words of the exchange whose ids a task holds before it packs them.
FLUSH_WORDS = 400_000


def word_splitter(spec: dict) -> Callable[[str], list[str]]:
    """The words, as the tokenizer's normalizer and pre-tokenizer make them, of one text."""
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or byte_level["type"] != "ByteLevel":
        raise ValueError("unsupported tokenizer: it must normalise by NFC, Replace and Lowercase and split by a pattern")
    specials = [t["content"] for t in spec["added_tokens"]]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("unsupported added token")
    pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
    general = regex.compile(pattern).findall
    # The same pattern for texts of Latin-1, with the classes spelt out.
    latin = [chr(k) for k in range(256)]
    classes = {p: "".join(re.escape(c) for c in latin if regex.match(p, c)) for p in (r"\p{White_Space}", r"\p{L}", r"\p{N}")}
    for p, chars in classes.items():
        pattern = pattern.replace(f"[{p}]", f"[{chars}]").replace(p, chars)
    narrow = re.compile(pattern).findall
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")").split if specials else None

    def plain(text: str) -> list[str]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return narrow(text)

    def words(text: str) -> list[str]:
        if cut and any(s in text for s in specials):
            parts = cut(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else plain(part))]
        return plain(text)

    return words


class _Positions(dict):
    """Position of each word in the order of first sight."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _pack(codes: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, low bytes first, which compress well."""
    return codes.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


_WORDS = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.int32())]))
_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("words", _WORDS)])


def _chunked(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        split, seen, n, chunk = word_splitter(json.loads(spec)), _Positions(), 0, uuid.uuid4().int >> 65

        def close():
            words = sorted(seen)  # neighbours in order compress better on their way
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(list(map(seen.__getitem__, words)), pa.int32())], ["word", "pos"])
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pairs)], schema=_CHUNKS)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                done, packed, size = at, [], 0
                while at < len(texts) and size < BATCH_BYTES and n < CHUNK_WORDS and len(seen) < CHUNK_DISTINCT:
                    text = texts[at].as_py() or ""
                    words = split(text)
                    packed.append(_pack(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))))
                    n, size, at = n + len(words), size + 4 * len(words) + len(text), at + 1
                rows = at - done
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk), pa.int64()), ids.slice(done, rows), pa.array(packed, pa.binary()), pa.nulls(rows, _WORDS)], schema=_CHUNKS)
                if n >= CHUNK_WORDS or len(seen) >= CHUNK_DISTINCT:
                    yield close()
                    seen, n, chunk = _Positions(), 0, uuid.uuid4().int >> 65
        yield close()
        del seen
        trim()

    return run


def _encoder(spec: str):
    """Encodes words that come in order, so that equal words are neighbours and each distinct word is encoded once, and
    packs, chunk by chunk, the places of the words and their ids. What is held is bounded by FLUSH_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        trim()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        held, n, last = [], 0, (None, None)

        def flush() -> pa.RecordBatch:
            chunk, place, length = (np.concatenate([h[k] for h in held]) for k in range(3))
            flat = np.concatenate([h[3] for h in held])
            begin = np.cumsum(length.astype(np.int64)) - length
            order = np.argsort(chunk, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                size = length[part].astype(np.int64)
                upto = np.cumsum(size)
                ids = flat[np.repeat(begin[part] - upto + size, size) + np.arange(upto[-1])]
                rows.append((int(chunk[part[0]]), *(zlib.compress(_pack(x), 1) for x in (place[part], length[part], ids))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["of_chunk", "places", "lengths", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(2).dictionary_encode()  # words in order of first sight
            new = codes.dictionary.to_pylist()
            known = [last[1]] if new[0] == last[0] else []
            ids = known + [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(new[len(known) :], add_special_tokens=False)]
            last = new[-1], ids[-1]
            own = [ids[k] for k in codes.indices.to_pylist()]
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.uint32), np.array([len(x) for x in own], np.uint32), np.concatenate(own)))
            n += batch.num_rows
            if n >= FLUSH_WORDS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()
        del held, last
        trim()

    return run


def pieces(spec: dict) -> list[str]:
    """The id-to-piece table of a tokenizer; its size is that of the vocabulary."""
    table = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [table.get(k, "") for k in range(max(table) + 1)]


def _assembler(table):
    def run(docs: pa.Table, vocabulary: pa.Table) -> pa.Table:
        """Ids and decoded text of a chunk's documents, from its words' ids."""
        piece = table.value
        place, length, flat = (np.concatenate([np.empty(0, np.uint32), *(_unpack(zlib.decompress(x.as_py())) for x in vocabulary[c])]) for c in ("places", "lengths", "ids"))
        begin, lengths = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        lengths[place] = length
        begin[place] = np.cumsum(length.astype(np.int64)) - length
        out, parts, held = [[], [], [], []], [], 0
        for doc_id, codes in zip(docs["doc_id"].to_pylist(), docs["codes"]):
            if (codes := codes.as_py()) is None:
                continue
            codes = _unpack(codes)
            n = lengths[codes]
            upto = np.cumsum(n)
            ids = flat[np.repeat(begin[codes] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
            for column, value in zip(out, (doc_id, len(ids), ids.astype("<u4").tobytes(), " ".join(map(piece.__getitem__, ids.tolist())))):
                column.append(value)
            held += len(out[2][-1]) + len(out[3][-1])
            if held >= BATCH_BYTES:
                parts.append(_batch(out))
                out, held = [[], [], [], []], 0
        parts.append(_batch(out))
        del out, begin, lengths, flat, place, length
        trim()
        return pa.concat_tables(parts)

    return run


def _batch(columns: list[list]) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, decoded as the pieces
    joined by spaces, as the library decodes without a decoder.

    Special strings in a text are special tokens, as in the library. Null or empty texts: no ids, empty text. Null ids
    and repeated rows are returned as they are. An empty table: no rows. Other columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    name = f"lonja_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.mapInArrow(_chunked(spec), "chunk long, doc_id long, codes binary, words array<struct<word:string,pos:int>>")
    writer = chunks.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", scratch(spark, name))
    drop_at_end(spark, name)
    writer.format("parquet").saveAsTable(name)
    stored = spark.table(name)
    words = stored.where("words IS NOT NULL").select("chunk", F.explode("words").alias("w")).select("chunk", "w.pos", "w.word").repartition(buckets, "word").sortWithinPartitions("word")
    vocabulary = words.mapInArrow(_encoder(spec), "of_chunk long, places binary, lengths binary, ids binary")
    texts = stored.where("words IS NULL").select("chunk", "doc_id", "codes")
    assemble = _assembler(spark.sparkContext.broadcast(pieces(json.loads(spec))))
    done = texts.groupBy("chunk").cogroup(vocabulary.groupBy("of_chunk")).applyInArrow(assemble, "doc_id long, n_tokens long, ids binary, decoded string")
    return done.withColumnRenamed("doc_id", id_col)
