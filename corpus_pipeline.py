"""A corpus pipeline: toxic documents go, poor documents go, one document of each group of near-duplicates stays, sources
are mixed to target weights, and the mix is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.bpe import encode_and_decode
from lonja.llm.common import materialize, read
from lonja.llm.mixing import mixed_documents
from lonja.llm.ngram_join import jaccard_components
from lonja.llm.quality import kept_documents
from lonja.llm.toxicity import clean_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; rows without an id stay.

    Rows equal in id and text are one document: of them the row whose other columns come first as JSON stays. Rows that
    share an id but not the text stay apart, so that none of two unlike texts is lost."""
    heads = materialize(jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = docs.join(heads, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as tokens: doc_id, n_tokens, the digest of the ids and that of the decoded text."""
    coded = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL counterpart: the classifier, the sketches and the seeded permutations are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
