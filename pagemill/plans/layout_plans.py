"""Queries over spans: furniture, lines, flow, probe and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..sources import derive as D
from .registry import query

_FONT = "fonts AS (SELECT doc_id, median(CASE WHEN font > 0 THEN font ELSE h END) AS body_font FROM d_spans GROUP BY doc_id)"
_ZONED = f"""zoned AS (SELECT *, CASE
    WHEN (body_font <= 0 OR font <= 0.9 * body_font) AND length(trim(text)) <= 120 AND y + h <= 0.06 * 600 THEN 'header'
    WHEN y >= 0.85 * 600 AND (regexp_matches(trim(text), '^[0-9]+$') OR (font <= 0.9 * body_font AND length(trim(text)) <= 4)) THEN 'footer' ELSE 'body' END AS zone
  FROM d_spans JOIN fonts USING (doc_id))"""


def _zoned(spark, sf):
    spans = D.spans(spark, sf)
    return L.zones(spans, L.body_font(spans), D.PAGE_HEIGHT)


@query(f"""WITH {D.SPANS}, {_FONT}, {_ZONED}
SELECT doc_id, max(body_font) AS body_font, count(*) FILTER (zone = 'header') AS n_header, count(*) FILTER (zone = 'footer') AS n_footer, count(*) FILTER (zone = 'body') AS n_body,
       CASE WHEN sum(length(text)) > 0 THEN round(coalesce(sum(length(text)) FILTER (zone = 'body'), 0) / sum(length(text)), 4) ELSE 1 END::DOUBLE AS coverage FROM zoned GROUP BY doc_id""")
def furniture_zones(spark, sf):
    of = lambda z: F.count(F.when(F.col("zone") == z, 1)).alias(f"n_{z}")
    chars = F.sum(F.length("text"))
    body = F.coalesce(F.sum(F.when(F.col("zone") == "body", F.length("text"))), F.lit(0))
    return _zoned(spark, sf).groupBy("doc_id").agg(F.max("body_font").alias("body_font"), of("header"), of("footer"), of("body"), F.when(chars > 0, F.round(body / chars, 4)).otherwise(1.0).alias("coverage"))


@query(f"WITH {D.SPANS} SELECT doc_id, page, median(font) AS body_font FROM d_spans GROUP BY doc_id, page")
def page_fonts(spark, sf):
    return D.spans(spark, sf).groupBy("doc_id", "page").agg(F.percentile("font", 0.5).alias("body_font"))


_STRIP = """strips AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no)::BIGINT AS strip FROM (
  SELECT *, CASE WHEN y - max(y + h) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 9 THEN 0 ELSE 1 END AS s FROM d_spans))"""


@query(f"WITH {D.SPANS}, {_STRIP} SELECT doc_id, page, strip, count(*) AS n_spans, min(y) AS y_start, max(y + h) AS y_end FROM strips GROUP BY doc_id, page, strip")
def strip_islands(spark, sf):
    return L.strips(D.spans(spark, sf)).groupBy("doc_id", "page", "strip").agg(F.count("*").alias("n_spans"), F.min("y").alias("y_start"), F.max(F.col("y") + F.col("h")).alias("y_end"))


@query(f"""WITH {D.SPANS}, t AS (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph FROM d_spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, line_no)),
v AS (SELECT doc_id, page, sum(CASE WHEN abs(y - py) <= 0.4 * greatest(h, ph) OR least(y + h, py + ph) > greatest(y, py) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no)::BIGINT AS visual_line FROM t)
SELECT doc_id, page, max(visual_line) AS n_lines, count(*) AS n_spans FROM v GROUP BY doc_id, page""")
def visual_lines(spark, sf):
    return L.visual_lines(D.spans(spark, sf)).groupBy("doc_id", "page").agg(F.max("visual_line").alias("n_lines"), F.count("*").alias("n_spans"))


@query(f"""WITH {D.SPANS}, t AS (SELECT *, lag(y + h) OVER w AS pb, lag(h) OVER w AS ph FROM d_spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, line_no)),
v AS (SELECT doc_id, page, line_no, sum(CASE WHEN y - pb <= 0.6 * greatest(h, ph) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no)::BIGINT AS row_no FROM t)
SELECT doc_id, page, row_no, count(*) AS n_spans, min(line_no) AS first_line FROM v GROUP BY doc_id, page, row_no""")
def row_clusters(spark, sf):
    return L.row_clusters(D.spans(spark, sf)).groupBy("doc_id", "page", "row_no").agg(F.count("*").alias("n_spans"), F.min("line_no").alias("first_line"))


@query(f"""WITH {D.SPANS}, t AS (SELECT *, lag(x) OVER w AS l, lag(x + w) OVER w AS r, lag(y + h) OVER w AS b, lag(h) OVER w AS ph FROM d_spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, line_no)),
v AS (SELECT *, sum(CASE WHEN abs(x - l) <= 2.5 AND abs(x + w - r) <= 2.5 AND y - b BETWEEN 0 AND 3 * greatest(h, ph, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no)::BIGINT AS run FROM t)
SELECT doc_id, page, run, count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '[\\p{{Nd}}.,%]+\\)?\\s*$')) AS n_numeric, min(y) AS top FROM v GROUP BY doc_id, page, run HAVING count(*) >= 3 AND 2 * n_numeric >= n_rows""")
def numeric_row_runs(spark, sf):
    return L.numeric_runs(D.spans(spark, sf))


@query(f"""WITH {D.SPANS}, t AS (SELECT *, regexp_matches(text, '^[A-Z !,]+$') AS head, lag(y + h) OVER w AS b, lag(h) OVER w AS ph FROM d_spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, line_no)),
u AS (SELECT *, lag(head) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no) AS after FROM t),
v AS (SELECT *, sum(CASE WHEN b IS NULL OR (y - b > 1.5 * greatest(h, ph, 1) AND trim(text, ' ') <> '') OR head OR after THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no)::BIGINT AS piece FROM u)
SELECT doc_id, page, piece, count(*) AS n_lines, sha256(trim(regexp_replace(string_agg(text, ' ' ORDER BY y, x, line_no), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), ' ')) AS text_sha FROM v GROUP BY doc_id, page, piece""")
def paragraph_pieces(spark, sf):
    rows = L.paragraph_pieces(D.spans(spark, sf), F.col("text").rlike("^[A-Z !,]+$"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "line_no", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("doc_id", "page", "piece").agg(F.count("*").alias("n_lines"), F.sha2(T.cleanup(text), 256).alias("text_sha"))


_EDGES = f"""{D.PIECES}, n AS (SELECT *, lead(pos) OVER w AS next_pos, lead(text) OVER w AS next_text, regexp_replace(trim(text, ' '), '["''\\)\\]\\}}\\x{{201D}}\\x{{2019}}\\s]+$', '') AS tail FROM d_cand WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
edges AS (SELECT doc_id, pos, next_pos, least(score, 95) / 100.0::DOUBLE AS confidence FROM (SELECT *, 45 + CASE WHEN regexp_matches(trim(next_text, ' '), '^\\p{{Ll}}') THEN 25 ELSE 0 END + CASE WHEN length(text) >= 170 THEN 15 ELSE 0 END AS score FROM n)
  WHERE next_pos IS NOT NULL AND tail <> '' AND NOT regexp_matches(tail, '[.!?:]$') AND score >= 60)"""


@query(f"WITH {_EDGES} SELECT * FROM edges")
def continuation_edges(spark, sf):
    return L.continuation(D.pieces(spark, sf), T.CLOSERS)


@query(f"""WITH {_EDGES}, r AS (SELECT p.doc_id, p.pos, e.confidence AS c, sum(CASE WHEN e.pos IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS chain FROM d_cand p LEFT JOIN edges e ON e.doc_id = p.doc_id AND e.next_pos = p.pos)
SELECT doc_id, min(pos) AS first_pos, count(*) AS n_pieces, min(c) AS confidence FROM r GROUP BY doc_id, chain HAVING count(*) > 1""")
def chain_merge(spark, sf):
    pieces = D.pieces(spark, sf)
    return L.chains(L.continuation(pieces, T.CLOSERS), pieces)


_MATH = "[=+*/<>^_|~]"
_PROBE = f"""pages_ AS (SELECT doc_id, page, sum(length(trim(text, ' '))) AS chars, sum(length(text) - length(regexp_replace(text, '{_MATH}', '', 'g'))) AS math FROM d_spans GROUP BY doc_id, page),
probe AS (SELECT doc_id, round(avg(CASE WHEN chars >= 20 THEN 1 ELSE 0 END), 6) AS native_ratio, round(CASE WHEN sum(chars) > 0 THEN sum(math) / sum(chars) ELSE 0 END, 6)::DOUBLE AS math_density FROM pages_ GROUP BY doc_id)"""


def _probe(spark, sf):
    math = F.length("text") - F.length(F.regexp_replace("text", _MATH, ""))
    pages = D.spans(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.sum(math).alias("math"))
    return pages.groupBy("doc_id").agg(F.round(F.avg((F.col("chars") >= 20).cast("int")), 6).alias("native_ratio"), F.round(F.when(F.sum("chars") > 0, F.sum("math") / F.sum("chars")).otherwise(0.0), 6).alias("math_density"))


@query(f"WITH {D.SPANS} SELECT doc_id, bool_or(chars >= 20) AS usable FROM (SELECT doc_id, page, sum(length(trim(text, ' '))) AS chars FROM d_spans GROUP BY doc_id, page) GROUP BY doc_id")
def text_admission(spark, sf):
    pages = D.spans(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return pages.groupBy("doc_id").agg(F.bool_or(F.col("chars") >= 20).alias("usable"))


@query(f"WITH {D.SPANS} SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM d_spans GROUP BY doc_id, page")
def union_rect(spark, sf):
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return D.spans(spark, sf).groupBy("doc_id", "page").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))


@query(f"WITH {D.SPANS} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, round_even(y / 4, 0) * 4, x, line_no)::BIGINT AS position FROM d_spans")
def reading_order(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("page", F.bround(F.col("y") / 4) * 4, "x", "line_no")
    return D.spans(spark, sf).select("doc_id", "line_no", F.row_number().over(w).cast("long").alias("position"))
