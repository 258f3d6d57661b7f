"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm import chat, collocations, spelling, urlfilter
from lonja.llm.bpe import encode_and_decode
from lonja.llm.common import WHITE_SPACE, read
from lonja.llm.embed_dedup import COSINE, cosine_components
from lonja.llm.html_text import page_texts
from lonja.llm.licenses import license_report
from lonja.llm.mixing import mix_report
from lonja.llm.ngram_join import jaccard_components
from lonja.llm.quality import judged
from lonja.llm.toxicity import toxicity
from lonja.llm.warc import LEAST_REVISIT_BYTES, page_captures

TOKENIZER = "word_bpe_49k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(read(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_captures(read(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(spark, read(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judged(read(spark, sf_dir, "documents"), ["doc_id"])
    return q.select("doc_id", *(f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.page_verdicts(read(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read(spark, sf_dir, "documents"), slips=199))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_embedding_dedup, op3_warc, op4_bpe, op5_chat_format, op6_quality_rules, op7_toxicity, op8_html_text, op9_source_mix, op10_url_filter, op11_license_scan, op12_collocations, op13_spelling_variants)}

_UPPER, _LOWER = urlfilter._UPPER, urlfilter._LOWER
_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_COMPONENTS = """
r(node, root) AS (SELECT id, id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(string_split(translate(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACES}, '      '), ' '), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT w.id, count(s.s) AS n FROM w LEFT JOIN s ON s.id = w.id GROUP BY w.id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
{_COMPONENTS}
SELECT n.id AS doc_id, n.n AS n_shingles, c.component_id FROM n JOIN c ON c.node = n.id
""",
    "op2_embedding_dedup": f"""
WITH RECURSIVE n AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM n WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}),
{_COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = n.id) AS n_links, c.component_id, n.id = c.component_id AS kept FROM n JOIN c ON c.node = n.id
""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op5_chat_format": chat.ORACLE_SQL,
    "op10_url_filter": urlfilter.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
