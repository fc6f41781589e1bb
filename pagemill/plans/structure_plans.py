"""Queries over page structure, fusion and probes, on the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import fusion as U
from ..operators import matching as X
from ..operators import structure as P
from ..sources import model as M
from .registry import query
from .text_plans import normalise_label

WIDTH, HEIGHT = 150.0, 300.0
#: Providers by capability and place, for routes and votes over the derived model.
REGISTRY = {
    "layout.region": {"primary": "mock", "challenger": "docling-sim"}, "table.structure": {"primary": "docling-sim", "fallback": "mock"}, "table.detection": {"primary": "mock", "challenger": "docling-sim"},
    "formula.detection": {"primary": "mock"}, "scholarly.metadata": {"primary": "grobid-sim"}, "scholarly.bibliography": {"primary": "grobid-sim"},
}
_PRIMARIES = {name: slots["primary"] for name, slots in REGISTRY.items()}


def _items(spark, sf, width=WIDTH):
    rows = M.df(spark, sf, "m_regions").where("kind <> 'FOOTNOTE'")
    return rows.select("page", F.col("region").alias("item"), "doc", "x", "y", "w", "h", "font", "text", "kind", (F.col("kind") == "FIGURE").alias("graphic"), F.lit(width).alias("page_width"), F.lit(10.0).alias("body_font"))


# Pages this narrow have no column under COLUMN_SHARE of their width, so columns are islands by a running maximum.
_BANDS = f"""{M.ctes('m_regions')}, items AS (SELECT page, region AS item, doc, x, y, w, h, text, kind = 'FIGURE' AS graphic FROM m_regions WHERE kind <> 'FOOTNOTE'),
st AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY y, x, item ROWS UNBOUNDED PRECEDING) - 1 AS band FROM (SELECT *, CASE WHEN y - max(y + h) OVER (PARTITION BY page ORDER BY y, x, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 9 THEN 0 ELSE 1 END AS s FROM items)),
co AS (SELECT *, sum(s) OVER (PARTITION BY page, band ORDER BY x, y, item ROWS UNBOUNDED PRECEDING) - 1 AS col FROM (SELECT * REPLACE (CASE WHEN x - max(x + w) OVER (PARTITION BY page, band ORDER BY x, y, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7 THEN 0 ELSE 1 END AS s) FROM st)),
placed AS (SELECT *, max(col) OVER (PARTITION BY page, band) + 1 AS n_columns, min(x) OVER c AS col_x, max(x + w) OVER c - min(x) OVER c AS col_w FROM co WINDOW c AS (PARTITION BY page, band, col)),
bands AS (SELECT doc, page, band::BIGINT AS band, n_columns::BIGINT AS n_columns, min(y) AS y_start, max(y + h) AS y_end, bool_or(graphic) AS graphic, CASE WHEN n_columns = 1 THEN max(col_w) / {WIDTH}::DOUBLE ELSE 0 END AS share FROM placed GROUP BY doc, page, band, n_columns),
modes AS (SELECT doc, page, band, n_columns, y_start, y_end, CASE WHEN n_columns >= 2 THEN 'MULTI_COLUMN' WHEN graphic AND share >= 0.5::DOUBLE AND (several OR share >= 0.6::DOUBLE) THEN 'SPANNING' WHEN several AND share >= 0.6::DOUBLE THEN 'FULL_WIDTH' ELSE 'SINGLE_COLUMN' END AS mode
  FROM (SELECT *, bool_or(n_columns >= 2) OVER (PARTITION BY doc) AS several FROM bands))"""


@query(f"WITH {_BANDS} SELECT page, item, band::BIGINT AS band, col::BIGINT AS col, n_columns::BIGINT AS n_columns, round(col_x, 6) AS col_x, round(col_w, 6) AS col_w FROM placed")
def page_columns(spark, sf):
    return P.bands(_items(spark, sf)).select("page", "item", "band", "col", "n_columns", F.round("col_x", 6).alias("col_x"), F.round("col_w", 6).alias("col_w"))


@query()
def narrow_columns(spark, sf):
    """The same on wide pages, where narrow columns join their neighbours."""
    return P.bands(_items(spark, sf, 480.0))


def _modes(spark, sf):
    items = _items(spark, sf)
    return P.classified(items, P.bands(items))


@query(f"WITH {_BANDS} SELECT * FROM modes")
def band_modes(spark, sf):
    return _modes(spark, sf)


_PROBE = f"""{_BANDS}, pages AS (SELECT doc, page, sum(length(trim(text, ' '))) AS chars, sum(length(text) - length(translate(text, '{R.FORMULA_CHARS}', ''))) AS math, bool_or(kind = 'TABLE') AS has_table,
  coalesce(sum(CASE WHEN kind = 'FIGURE' THEN w * h END), 0) / {WIDTH * HEIGHT}::DOUBLE AS g FROM m_regions GROUP BY doc, page),
pc AS (SELECT doc, page, arg_max(n_columns, {{'n': n, 'f': -f}}) AS n_columns FROM (SELECT doc, page, n_columns, count(*) AS n, min(band) AS f FROM modes GROUP BY ALL) GROUP BY doc, page),
dc AS (SELECT doc, arg_max(n_columns, {{'n': n, 'f': -f}}) AS estimated_columns, 1 - max(n) / sum(n) AS mixed FROM (SELECT doc, n_columns, count(*) AS n, min(page) AS f FROM pc GROUP BY ALL) GROUP BY doc),
va AS (SELECT doc, count(DISTINCT mode) AS v FROM modes GROUP BY doc),
w AS (SELECT doc, avg(CASE WHEN chars >= 20 THEN 1 ELSE 0 END) AS native, CASE WHEN sum(chars) > 0 THEN sum(math) / sum(chars) ELSE 0 END AS math, avg(CASE WHEN has_table THEN 1 ELSE 0 END) AS tab, avg(least(g, 1)) AS image FROM pages GROUP BY doc),
probe AS (SELECT w.*, estimated_columns, least(1, 0.4::DOUBLE * greatest(coalesce(v, 0) - 1, 0) / 3 + 0.3::DOUBLE * image + 0.3::DOUBLE * coalesce(mixed, 0)) AS complexity FROM w LEFT JOIN dc USING (doc) LEFT JOIN va USING (doc))"""


def _probe(spark, sf):
    t = F.col("text")
    figure = F.sum(F.when(F.col("kind") == "FIGURE", F.col("w") * F.col("h")))
    pages = M.df(spark, sf, "m_regions").groupBy("doc", "page").agg(
        F.sum(F.length(F.trim(t))).alias("chars"), F.sum(R.count_of(t, R.FORMULA_CHARS)).alias("math"), F.max(F.col("kind") == "TABLE").alias("has_table"),
        (F.coalesce(figure, F.lit(0.0)) / (WIDTH * HEIGHT)).alias("graphic_share"), F.lit(True).alias("has_text"),
    )
    return P.probe(pages, _modes(spark, sf))


@query(f"WITH {_PROBE} SELECT doc, round(native, 6) AS native_text_ratio, round(1 - native, 6) AS scanned_page_ratio, round(math, 6)::DOUBLE AS math_density, round(tab, 6) AS table_density, round(image, 6) AS image_density, estimated_columns, round(complexity, 6) AS layout_complexity FROM probe")
def document_probe(spark, sf):
    rows = _probe(spark, sf)
    return rows.select("doc", *(F.round(c, 6).alias(c) for c in ("native_text_ratio", "scanned_page_ratio", "math_density", "table_density", "image_density")), "estimated_columns", F.round("layout_complexity", 6).alias("layout_complexity"))


@query(f"""WITH {_PROBE} SELECT doc, 'refused' AS provider, '' AS capabilities FROM probe WHERE native = 0
UNION ALL SELECT doc, 'mock', CASE WHEN math >= 0.05::DOUBLE THEN 'layout.region,formula.detection' ELSE 'layout.region' END FROM probe WHERE native > 0
UNION ALL SELECT doc, 'docling-sim', 'table.structure,table.detection' FROM probe WHERE native > 0 AND tab >= 0.1::DOUBLE UNION ALL SELECT doc, 'grobid-sim', 'scholarly.metadata,scholarly.bibliography' FROM probe WHERE native > 0""")
def routing_plan(spark, sf):
    return P.routes(_probe(spark, sf), _PRIMARIES).drop("reason")


@query()
def line_blocks(spark, sf):
    return P.blocks(_items(spark, sf).where("NOT graphic"))


@query()
def candidate_regions(spark, sf):
    return P.candidates(_items(spark, sf).where("NOT graphic"))


@query()
def graphic_fixpoint(spark, sf):
    return P.graphics(M.df(spark, sf, "m_regions").where("kind IN ('FIGURE', 'TABLE')").select("page", F.col("region").alias("item"), "x", "y", "w", "h"))


@query()
def note_flow(spark, sf):
    rows = M.df(spark, sf, "m_regions").withColumn("kind", F.when(F.col("kind") == "FOOTNOTE", "TEXT").otherwise(F.col("kind"))).withColumn("label", F.when(F.col("label") == "FOOTNOTE", "TEXT").otherwise(F.col("label")))
    return P.footnotes(rows.select("page", F.col("region").alias("item"), "kind", "label", "text", "x", "y", "w", "h", F.least("font", F.lit(9.0)).alias("font"), F.lit(150.0).alias("page_height"), F.lit(10.0).alias("body_font")))


@query()
def merged_lines(spark, sf):
    """Fragments of lines: items side by side, a few points apart."""
    rows = M.df(spark, sf, "m_regions").select("page", F.col("n").alias("seq"), (F.col("n") * 60 + F.col("part") % 9).cast("double").alias("x"), (F.col("part") % 5 * 3).cast("double").alias("y"), F.lit(57.0).alias("w"), F.lit(10.0).alias("h"), "text", "font")
    return P.merge_fragments(rows)


@query()
def cell_pieces(spark, sf):
    """Characters of each text at five points each, with a wide gap after each fourth."""
    rows = M.df(spark, sf, "m_regions").select(F.col("region").alias("rect"), F.posexplode(F.split("text", "")).alias("seq", "char"))
    rows = rows.withColumn("x", (F.col("seq") * 5 + F.expr("seq div 4") * 31).cast("double")).withColumn("w", F.lit(5.0)).withColumn("font", F.lit(10.0))
    return P.cells_of_rects(rows)


@query()
def table_grids(spark, sf):
    rows = M.df(spark, sf, "m_regions").select("page", F.col("region").alias("item"), (F.col("n") % 2 * 200 + F.col("part") % 3).cast("double").alias("x"), (F.expr("n div 2") * 30).cast("double").alias("y"), F.lit(60.0).alias("w"), F.lit(12.0).alias("h"))
    return P.grids(rows)


# Candidates: a parser sees each region a little moved.
_CANDS = f"""{M.ctes('m_regions', 'm_pages')}, cands AS (SELECT region AS candidate, CASE WHEN region % 37 = 0 THEN -page ELSE page END AS page, CASE part % 5 WHEN 0 THEN 'TABLE_STRUCTURE' WHEN 1 THEN 'FORMULA' WHEN 2 THEN 'METADATA' ELSE 'REGION' END AS type, x + part % 7 AS x, y + 3 AS y,
  CASE WHEN region % 41 = 0 THEN 0 ELSE w END AS w, h, CASE part % 3 WHEN 0 THEN 'title' WHEN 1 THEN ' Para ' ELSE 'nonsense' END AS native, text AS preview, CASE WHEN part % 2 = 0 THEN text ELSE '' END AS unicode, 'raw' AS raw, 0.5 + part % 10 / 20.0 AS confidence FROM m_regions),
normal AS (SELECT candidate, page, x, y, w, h, CASE type WHEN 'TABLE_STRUCTURE' THEN 'TABLE' WHEN 'FORMULA' THEN 'FORMULA' ELSE CASE part WHEN 0 THEN 'HEADING_LIKE' WHEN 1 THEN 'PARAGRAPH_LIKE' ELSE 'UNKNOWN' END END AS label,
  CASE type WHEN 'REGION' THEN preview WHEN 'FORMULA' THEN coalesce(nullif(unicode, ''), raw) ELSE '' END AS text, confidence::DOUBLE AS confidence FROM (SELECT c.*, CASE native WHEN 'title' THEN 0 WHEN ' Para ' THEN 1 ELSE 2 END AS part FROM cands c)
  WHERE type <> 'METADATA' AND w > 0 AND h > 0 AND page IN (SELECT page FROM m_pages))"""


def _candidates(spark, sf):
    p, r = F.col("part"), F.col("region")
    rows = M.df(spark, sf, "m_regions").select(
        r.alias("candidate"), F.when(r % 37 == 0, -F.col("page")).otherwise(F.col("page")).alias("page"), F.when(p % 5 == 0, "TABLE_STRUCTURE").when(p % 5 == 1, "FORMULA").when(p % 5 == 2, "METADATA").otherwise("REGION").alias("type"),
        (F.col("x") + p % 7).alias("x"), (F.col("y") + 3).alias("y"), F.when(r % 41 == 0, 0.0).otherwise(F.col("w")).alias("w"), "h", F.when(p % 3 == 0, "title").when(p % 3 == 1, " Para ").otherwise("nonsense").alias("native"),
        F.col("text").alias("preview"), F.when(p % 2 == 0, F.col("text")).otherwise("").alias("unicode"), F.lit("raw").alias("raw"), F.lit("").alias("latex"), (F.lit(0.5) + p % 10 / 20).alias("confidence"), F.when(p % 4 == 0, "docling-sim").otherwise("mock").alias("provider"),
    )
    return U.normalised(rows, M.df(spark, sf, "m_pages"), normalise_label(F.col("native")))


@query(f"WITH {_CANDS} SELECT candidate, page, label, text, round(confidence, 6) AS confidence, x, w FROM normal")
def candidate_normalise(spark, sf):
    return _candidates(spark, sf).select("candidate", "page", "label", "text", F.round("confidence", 6).alias("confidence"), "x", "w")


@query(f"WITH {_CANDS} SELECT candidate, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN label IN ('TABLE', 'FORMULA') THEN 0 ELSE 1 END, confidence DESC, candidate)::BIGINT AS position FROM normal")
def fusion_order(spark, sf):
    return U.processing_order(_candidates(spark, sf)).select("candidate", "position")


@query()
def fused_regions(spark, sf):
    rows = _items(spark, sf)
    blocks = rows.where("NOT graphic").select("page", "item", "x", "y", "w", "h", F.when(F.col("font") > 10, "HEADING_LIKE").otherwise("PARAGRAPH_LIKE").alias("label"), F.lit(0.75).alias("confidence"), "text")
    return U.fuse(blocks, _candidates(spark, sf), REGISTRY)


@query(f"WITH {M.ctes('m_regions')} SELECT page, region, CASE WHEN label IN ('FOOTNOTE', 'FIGURE', 'TABLE', 'FORMULA', 'HEADER', 'FOOTER') THEN label ELSE 'TEXT' END AS kind, (row_number() OVER (PARTITION BY page ORDER BY y, x, text, region) - 1)::BIGINT AS ordinal FROM m_regions")
def region_order(spark, sf):
    return U.final_order(M.df(spark, sf, "m_regions")).select("page", "region", U.kind_of(F.col("label")).alias("kind"), "ordinal")


@query(f"""WITH {M.ctes('m_regions')}, c AS (SELECT region, CASE part % 3 WHEN 0 THEN 'layout.region' WHEN 1 THEN 'table.structure' ELSE 'formula.detection' END AS capability, CASE supp % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'docling-sim' WHEN 2 THEN 'grobid-sim' ELSE 'other' END AS provider FROM m_regions)
SELECT region, CASE capability WHEN 'layout.region' THEN CASE provider WHEN 'mock' THEN 0 WHEN 'docling-sim' THEN 1 ELSE 3 END WHEN 'table.structure' THEN CASE provider WHEN 'docling-sim' THEN 0 WHEN 'mock' THEN 2 ELSE 3 END ELSE CASE provider WHEN 'mock' THEN 0 ELSE 3 END END::BIGINT AS rank FROM c""")
def authority_ranks(spark, sf):
    capability = F.when(F.col("part") % 3 == 0, "layout.region").when(F.col("part") % 3 == 1, "table.structure").otherwise("formula.detection")
    provider = F.when(F.col("supp") % 4 == 0, "mock").when(F.col("supp") % 4 == 1, "docling-sim").when(F.col("supp") % 4 == 2, "grobid-sim").otherwise("other")
    return M.df(spark, sf, "m_regions").select("region", U.rank(capability, provider, REGISTRY).cast("long").alias("rank"))


@query(f"""WITH {M.ctes('m_regions')} SELECT region, CASE WHEN part % 3 = 0 THEN 'FOOTNOTE' WHEN part % 3 = 1 THEN label WHEN part % 2 = 0 THEN 'UNKNOWN' ELSE kind END AS label FROM m_regions""")
def dominant_labels(spark, sf):
    three = F.col("part") % 3
    labels = F.when(three == 0, F.array(F.lit("FOOTNOTE"), F.col("label"))).when(three == 1, F.array("label")).otherwise(F.array().cast("array<string>"))
    return M.df(spark, sf, "m_regions").select("region", U.dominant(labels, F.when(F.col("part") % 2 == 0, "UNKNOWN").otherwise(F.col("kind"))).alias("label"))


@query(f"""WITH {_CANDS}, a AS (SELECT candidate, page, 0 AS member, 'mock' AS provider FROM normal WHERE candidate % 2 = 0), b AS (SELECT candidate, page, 1 AS member, 'docling-sim' AS provider FROM normal WHERE candidate % 3 = 0)
SELECT candidate, member::BIGINT AS member, provider, 'ensemble:mock+docling-sim' AS bundle, '1+2' AS version FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def bundle_merge(spark, sf):
    c = _candidates(spark, sf)
    name, version, rows = U.bundle([("mock", "1", c.where("candidate % 2 = 0")), ("docling-sim", "2", c.where("candidate % 3 = 0"))], ["0.1.0", "0.1.0"])
    return rows.select("candidate", "member", "provider", F.lit(name).alias("bundle"), F.lit(version).alias("version"))


@query(f"""WITH {M.ctes('m_regions')}, n AS (SELECT doc, region, row_number() OVER (PARTITION BY doc ORDER BY page, n) AS c FROM m_regions WHERE kind = 'TABLE') SELECT region, c::BIGINT AS counter, substr(sha256(concat_ws(chr(31), doc, 'evidence', 'docling:' || c)), 1, 32) AS evidence_id FROM n""")
def sink_ids(spark, sf):
    return U.sink_ids(M.df(spark, sf, "m_regions").where("kind = 'TABLE'"), ["doc"], ["page", "n"], "docling:").select("region", "counter", "evidence_id")


_LINKED = ", l AS (SELECT region, region + (part % 3) * 10 AS candidate FROM m_regions WHERE kind IN ('TABLE', 'FORMULA') UNION ALL SELECT region, region + 1 FROM m_regions WHERE kind IN ('TABLE', 'FORMULA')), c AS (SELECT region AS candidate, n AS position, part % 2 AS n_cells FROM m_regions)"


@query(f"WITH {M.ctes('m_regions')}{_LINKED} SELECT region, arg_min(candidate, {{'p': position, 'c': candidate}}) AS candidate FROM (SELECT DISTINCT * FROM l) JOIN c USING (candidate) WHERE n_cells > 0 GROUP BY region HAVING count(*) = count(DISTINCT position)")
def evidence_links(spark, sf):
    regions = M.df(spark, sf, "m_regions")
    own = regions.where("kind IN ('TABLE', 'FORMULA')").select("region", F.array(F.col("region") + F.col("part") % 3 * 10, F.col("region") + 1).alias("evidence"))
    cands = regions.select(F.col("region").alias("candidate"), F.col("n").alias("position"), (F.col("part") % 2).alias("n_cells"))
    several = own.select("region", F.explode("evidence").alias("candidate")).distinct().join(cands.where("n_cells > 0"), "candidate").groupBy("region").agg((F.count("*") == F.countDistinct("position")).alias("_ok"))
    return U.linked_evidence(own, cands, need_cells=True).join(several.where("_ok"), "region").select("region", "candidate")


@query(f"""WITH {M.ctes('m_regions')}, f AS (SELECT DISTINCT doc, part % 4 AS k FROM m_regions), t AS (SELECT doc, k, (['mock', 'docling-sim', 'grobid-sim', 'odd'])[k::INT + 1] AS provider, ([['layout.region'], ['table.structure', 'table.detection'], ['scholarly.bibliography'], ['strange']])[k::INT + 1] AS caps, CASE WHEN k = 1 THEN ['mock'] ELSE [] END AS subs, CASE WHEN k = 2 THEN repeat('x', 600) ELSE 'lost' END AS e FROM f),
m AS (SELECT *, 'ValueError: ' || CASE WHEN length(e) > 500 THEN left(e, 500) || '...' ELSE e END AS msg, array_to_string(subs, ', ') AS s FROM t)
SELECT doc, (['LAYOUT_REGION', 'TABLE_RECOVERY', 'CITATION_RESOLUTION', 'LAYOUT_REGION'])[k::INT + 1] AS category, 'ERROR' AS severity, provider AS producer, 'evidence provider ''' || provider || ''' failed for ' || array_to_string(caps, ', ') || ': ' || msg || CASE WHEN s <> '' THEN '; substituted by ' || s ELSE '' END AS message,
CASE WHEN s <> '' THEN 'provider substitution: ' || s ELSE (['internal geometry blocking', '', 'bibliography text heuristics', 'internal baseline'])[k::INT + 1] END AS fallback, substr(sha256(concat_ws(chr(31), doc, 'issue', provider, array_to_string(caps, ','), msg)), 1, 32) AS issue_id FROM m""")
def degradation_issues(spark, sf):
    k = (F.col("k") + 1).cast("int")
    lists = lambda *xs: F.element_at(F.array(*[F.array(*[F.lit(y) for y in x]) for x in xs]), k)
    rows = M.df(spark, sf, "m_regions").select("doc", (F.col("part") % 4).alias("k")).distinct()
    rows = rows.select(
        "doc", F.element_at(F.array(*[F.lit(p) for p in ("mock", "docling-sim", "grobid-sim", "odd")]), k).alias("provider"), lists(["layout.region"], ["table.structure", "table.detection"], ["scholarly.bibliography"], ["strange"]).alias("capabilities"),
        F.when(k == 2, F.array(F.lit("mock"))).otherwise(F.array().cast("array<string>")).alias("substitutes"), F.lit("ValueError").alias("error_type"), F.when(k == 3, F.repeat(F.lit("x"), F.lit(600))).otherwise("lost").alias("error"),
    )
    return U.degradation_issues(rows)


@query()
def caption_greedy(spark, sf):
    """Captions of the figures and tables of each page; its items stand closer here, so that there are pairs."""
    rows = M.df(spark, sf, "m_regions")
    return X.captions(rows.select("page", F.col("region").alias("box_id"), "kind", "label", "text", F.when(F.col("kind") == "TEXT", F.col("font")).otherwise(0.0).alias("font"), (F.col("x") / 8).alias("x"), (F.col("y") + F.col("n") * 10).alias("y"), "w", "h"))
