"""Queries of page layouts and of the seeded sample, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.operators import layout, sampling
from lonja.plans import domain as d

_WORDS = ["Model", "K123", "COLOR", " Axis ", "Picture", "wired", "USD", "Key Switch", "68 Keys", "item"]


def _items(s, sf):
    """Page items on pages of their own for every customer's region of the list, with words of headers among them."""
    k = F.col("item")
    return d.page_items(s, sf).withColumns({"page": F.floor(k / 64).cast("long"), "y": F.col("y") % 240, "x": (k % 23 * 20).cast("double"), "text": d._pick(_WORDS, F.floor(k / 3).cast("long"))})


def _anchors(s, sf):
    return d.page_items(s, sf).where("item % 11 = 0").withColumns({"page": F.floor(F.col("item") / 64).cast("long"), "y": F.col("y") % 240, "x": F.col("item") % 3 * 35 + 250.0})


def _listed(s, sf):
    """Extracted rows by file, among them a file of three rows and one of a null name."""
    k = F.col("row_seq")
    return d.items(s, sf).select("row_seq", F.when(k <= 3, "A small.pdf").when(k % 50 == 0, F.lit(None)).otherwise(F.col("file")).alias("file"))


QUERIES = {
    "g1_layout": lambda s, sf: layout.layouts(_anchors(s, sf)),
    "g3_headers": lambda s, sf: layout.headers(_items(s, sf), _anchors(s, sf)).select("file", "page", "band", "item", "y", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["role"], c["x"].cast("string"))), " ").alias("columns")),
    "o7_seeded_sample": lambda s, sf: sampling.sampled(_listed(s, sf)).select("file", "row_seq", "pick"),
    "g4_columns": lambda s, sf: layout.classified(_items(s, sf), _anchors(s, sf)).select("file", "page", "item", "header", "role"),
}

_PAGES = f"""{d.SQL_ITEMS}, it AS (SELECT file, item // 64 AS page, item, (item % 23 * 20)::DOUBLE AS x, y % 240 AS y, {d._sql_pick(_WORDS, 'item // 3')} AS text FROM items), an AS (SELECT file, item // 64 AS page, item, item % 3 * 35 + 250::DOUBLE AS x, y % 240 AS y FROM items WHERE item % 11 = 0)"""
_ROLE = "CASE " + " ".join(f"WHEN regexp_full_match(trim(text), '(?i){p}') THEN '{r}'" for r, p in layout.ROLES.items()) + " END"
_HEADERS = f"""{_PAGES}, wd AS (SELECT it.*, {_ROLE} AS role, floor(it.y / 6 + 0.5::DOUBLE)::BIGINT AS band FROM it JOIN (SELECT file, page, min(x) AS price_x FROM an GROUP BY ALL) f ON f.file = it.file AND f.page = it.page AND it.x < price_x - 10 WHERE {_ROLE} IS NOT NULL),
fr AS (SELECT file, page, band, role, arg_min(x, item) AS x, min(item) AS item FROM wd GROUP BY ALL), co AS (SELECT file, page, band, list({{'x': x, 'item': item, 'role': role}} ORDER BY x, item) AS columns FROM fr GROUP BY ALL),
hd AS (SELECT w.file, w.page, w.band, w.item, w.y, columns FROM (SELECT file, page, band, min(item) AS item, arg_min(y, item) AS y, count(*) AS n, max(x) - min(x) AS spread, bool_or(role IN ('model', 'color', 'switch')) AS product FROM wd GROUP BY ALL) w JOIN co USING (file, page, band) WHERE n >= 2 AND spread >= 40 AND product AND len(columns) >= 2)"""

def _times(a: str, b: str) -> str:
    return f"((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


def _sample_sql() -> str:
    """The generator step by step, then pick after pick: each draw counts the places left."""
    steps = f"""fl AS (SELECT *, CASE WHEN row_seq <= 3 THEN 'A small.pdf' WHEN row_seq % 50 = 0 THEN NULL ELSE file END AS f FROM rows), pl AS (SELECT f, row_seq, row_number() OVER (PARTITION BY f ORDER BY row_seq) - 1 AS place FROM fl),
sz AS (SELECT f, count(*) AS n, least(count(*), {sampling.PICKS}) AS take FROM pl GROUP BY f), of AS (SELECT *, coalesce(sum(take) OVER (ORDER BY f NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS drawn FROM sz),
dr AS (SELECT f, n, k, ({sampling.SEED} + (drawn + k) * {sampling.STEP}) % 4294967296 AS s FROM of, range(1, {sampling.PICKS + 1}) r(k) WHERE k <= take), t1 AS (SELECT *, {_times('xor(s, s >> 15)', 's | 1')} AS t FROM dr),
t2 AS (SELECT f, n, k, xor((t + {_times('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) AS t FROM t1), ix AS (SELECT f, k, floor(xor(t, t >> 14)::DOUBLE / 4294967296 * (n - k + 1))::BIGINT AS i FROM t2),
pk0 AS (SELECT f, []::BIGINT[] AS taken FROM sz)"""
    for k in range(1, sampling.PICKS + 1):
        steps += f", pk{k} AS (SELECT p.f, CASE WHEN i IS NULL THEN taken ELSE list_append(taken, list_reduce(list_concat([i], list_sort(taken)), lambda o, z: CASE WHEN z <= o THEN o + 1 ELSE o END)) END AS taken FROM pk{k - 1} p LEFT JOIN ix ON ix.f IS NOT DISTINCT FROM p.f AND ix.k = {k})"
    return f"WITH {d.SQL_ROWS}, {steps}, tk AS (SELECT f, unnest(taken) AS place, unnest(range(1, len(taken) + 1)) AS pick FROM pk{sampling.PICKS}) SELECT tk.f AS file, row_seq, pick::INT AS pick FROM tk JOIN pl ON pl.f IS NOT DISTINCT FROM tk.f AND pl.place = tk.place"


ORACLE_SQL = {
    "o7_seeded_sample": _sample_sql(),
    "g1_layout": f"""WITH RECURSIVE {_PAGES}, o AS (SELECT file, page, x, row_number() OVER (PARTITION BY file, page ORDER BY item) AS k FROM an), st(file, page, k, cols) AS (SELECT file, page, 1::BIGINT, [x] FROM o WHERE k = 1 UNION ALL SELECT st.file, st.page, o.k, CASE WHEN len(list_filter(cols, lambda c: abs(c - o.x) < 40)) > 0 THEN cols ELSE list_append(cols, o.x) END FROM st JOIN o ON o.file = st.file AND o.page = st.page AND o.k = st.k + 1),
c AS (SELECT file, page, arg_max(len(cols), k)::INT AS columns FROM st GROUP BY ALL), p AS (SELECT l.file, l.page, bool_or(abs(l.y - r.y) <= 30 AND abs(l.x - r.x) >= 40) AS same_row FROM an l JOIN an r ON r.file = l.file AND r.page = l.page GROUP BY ALL)
SELECT file, page, columns, same_row, CASE WHEN columns = 1 OR (columns <= 2 AND NOT same_row) THEN 'table' ELSE 'grid' END AS layout FROM c JOIN p USING (file, page)""",
    "g3_headers": f"WITH {_HEADERS} SELECT file, page, band, item, y, array_to_string(list_transform(columns, lambda c: c.role || ':' || c.x), ' ') AS columns FROM hd",
    "g4_columns": f"""WITH {_HEADERS}, ab AS (SELECT it.file, it.page, it.item, it.x, arg_min({{'item': hd.item, 'columns': columns}}, {{'y': -hd.y, 'i': hd.item}}) AS h FROM it LEFT JOIN hd ON hd.file = it.file AND hd.page = it.page AND hd.y < it.y GROUP BY ALL),
b AS (SELECT file, page, item, x, h.item AS header, h.columns AS c FROM ab) SELECT file, page, item, header, CASE WHEN header IS NULL THEN NULL WHEN x >= c[-1].x + 60 THEN 'skip' ELSE list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN (i = 1 OR x >= (c[i - 1].x + c[i].x) / 2) AND (i = len(c) OR x < (c[i].x + c[i + 1].x) / 2) THEN CASE WHEN c[i].role IN ('model', 'color', 'switch') THEN c[i].role ELSE 'skip' END END), lambda z: z IS NOT NULL)[1] END AS role FROM b""",
}
