"""Queries of text search by first hit and of tariff codes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import vocabulary as v
from lonja.operators import search
from lonja.plans import domain as d

_GOODS = ["Teclado mecanico para computadora", "Indicadores apuntadores raton inalambrico", "Auriculares con microfono", "Monitor de pantalla plana", "Interruptor magnetico de efecto hall", "Ventilador axial", "Cafetera electrica", "Mando para consola", "Tecla de repuesto", "Impresora laser", None]


def _tariffs(s, sf):
    """Every second part as a tariff row: its goods, its name, an eight-digit code."""
    k = F.col("row_seq")
    code = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(".00"))
    return d.catalog(s, sf).where(k % 2 == 0).select(k.alias("line"), code.alias("ncm"), F.concat(d._pick(_GOODS, F.floor(k / 2).cast("long")), F.lit(" "), "modelo").alias("desc"), ((k % 5) / 100).alias("duty"))


QUERIES = {
    "o2_first_hits": lambda s, sf: search.search(s.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query"), "text"), search.inverted_index(s.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), first_hit=True).select("query", "id", "score", "place"),
    "x7_tariff_codes": lambda s, sf: search.classified(d.items(s, sf), "row_seq", F.concat_ws(" ", "modelo", "variante", "marca"), _tariffs(s, sf)),
}

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3)"
_EXPANDED = "' ' || lower(concat_ws(' ', modelo, variante, marca)) || ' '"
for _w, _s in v.SYNONYMS.items():
    _EXPANDED = rf"regexp_replace({_EXPANDED}, '\b{_w}\b', ' {_s} ', 'g')"
#: Scores of a(query, ws) against i(token, id): full join, then score, earliest word, id.
_PLACED = """w AS (SELECT query, unnest(ws) AS token, generate_subscripts(ws, 1) AS at_word FROM a), h AS (SELECT query, id, count(*) AS score, min(at_word) AS first FROM w JOIN i USING (token) GROUP BY query, id),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, id) AS place FROM h)"""

ORACLE_SQL = {
    "o2_first_hits": f"WITH i AS (SELECT DISTINCT unnest({_WORDS.format(t='text')}) AS token, doc_id AS id FROM documents), a AS (SELECT item_id AS query, {_WORDS.format(t='text')} AS ws FROM benchmark), {_PLACED} SELECT query, id, score, place FROM p WHERE place <= 3",
    "x7_tariff_codes": f"""WITH {d.SQL_ROWS}, t AS (SELECT row_seq AS line, lpad((row_seq % 10000)::VARCHAR, 4, '0') || '.' || lpad((row_seq % 97)::VARCHAR, 2, '0') || '.00' AS ncm, {d._sql_pick(_GOODS, 'row_seq // 2')} || ' ' || modelo AS "desc", (row_seq % 5) / 100::DOUBLE AS duty FROM catalog WHERE row_seq % 2 = 0),
i AS (SELECT DISTINCT unnest({_WORDS.format(t="concat_ws(' ', coalesce(" + '"desc"' + ", ''), ncm)")}) AS token, line AS id FROM t), x AS (SELECT row_seq AS query, {_EXPANDED} AS e FROM rows), a AS (SELECT query, {_WORDS.format(t='e')} AS ws FROM x), {_PLACED},
b AS (SELECT a.query, len(ws) AS n, p.id, coalesce(score, 0) AS score, least(1::DOUBLE, coalesce(score, 0) / greatest(2, len(ws))) AS confidence FROM a LEFT JOIN p ON p.query = a.query AND p.place = 1), c AS (SELECT *, id IS NOT NULL AND confidence >= {search.LEAST_SHARE}::DOUBLE AND score >= {search.LEAST_SCORE} AS ok FROM b)
SELECT query AS row_seq, t.ncm, t."desc", t.duty, score, confidence, id IS NOT NULL AND NOT ok AS pending FROM c LEFT JOIN t ON c.ok AND t.line = c.id""",
}
