"""Queries over reading flow and over what the reader shows, on the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import flow as W
from ..operators import structure as P
from ..operators import viewer as V
from ..sources import model as M
from .registry import query
from .structure_plans import _BANDS, _items

_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def _flow(spark, sf):
    items = _items(spark, sf)
    placed = P.bands(items)
    modes = P.classified(items, placed).select("page", "band", "mode")
    rows = placed.join(M.df(spark, sf, "m_regions").select(F.col("region").alias("item"), "doc", "kind", "label", "text", "x", "y", "w", "part"), "item").join(modes, ["page", "band"])
    multi = F.max(F.col("mode") == "MULTI_COLUMN").over(P.Window.partitionBy("page"))
    order = P.Window.partitionBy("doc").orderBy("page", "band", "col", F.bround(F.col("y") / 4) * 4, "x", "item")
    return rows.select("doc", F.col("item").alias("region"), F.row_number().over(order).cast("long").alias("pos"), "kind", "label", "text", "w", F.when(F.col("part") % 3 > 0, F.col("w")).otherwise(F.col("w") / 2).alias("last_w"), "page", "band", "mode", "col", "col_x", "col_w", multi.alias("page_multi"))


_FLOWED = f"""{_BANDS}, fl AS (SELECT r.doc, r.region, row_number() OVER (PARTITION BY r.doc ORDER BY r.page, p.band, p.col, round_even(r.y / 4, 0) * 4, r.x, r.region) AS pos, r.kind, r.label, r.text, r.w, CASE WHEN r.part % 3 > 0 THEN r.w ELSE r.w / 2 END AS last_w, r.page, p.band, m.mode, p.col, p.col_x, p.col_w,
  bool_or(m.mode = 'MULTI_COLUMN') OVER (PARTITION BY r.page) AS multi FROM placed p JOIN m_regions r ON r.region = p.item JOIN modes m ON m.page = p.page AND m.band = p.band),
ed AS (SELECT t.doc, s.region AS source, t.region AS target, s.page AS sp, t.page AS tp, s.band AS sb, t.band AS tb, s.mode AS sm, t.mode AS tm, s.col AS sc, t.col AS tc, s.col_x AS sx, t.col_x AS tx, s.col_w AS sw, t.col_w AS tw, t.multi AS multi, s.kind AS sk, t.kind AS tk, s.label AS sl, t.label AS tl, s.text AS st, t.text AS tt, s.w AS w, s.last_w AS lw, t.pos AS pos FROM fl s JOIN fl t ON t.doc = s.doc AND t.pos = s.pos + 1)"""
_GOES = """CASE WHEN {a}sk = 'TEXT' AND {a}tk = 'TEXT' AND {a}sl NOT IN ('HEADING_LIKE', 'CAPTION_LIKE', 'FOOTNOTE') AND {a}tl NOT IN ('HEADING_LIKE', 'CAPTION_LIKE', 'FOOTNOTE') AND {end} <> '' AND NOT regexp_matches({end}, '[.!?:]$')
  AND 45 + CASE WHEN regexp_matches({tt}, '^\\p{{Ll}}') THEN 25 ELSE 0 END + CASE WHEN {a}w > 0 AND {a}lw >= 0.85::DOUBLE * {a}w THEN 15 ELSE 0 END >= 60 THEN least(45 + CASE WHEN regexp_matches({tt}, '^\\p{{Ll}}') THEN 25 ELSE 0 END + CASE WHEN {a}w > 0 AND {a}lw >= 0.85::DOUBLE * {a}w THEN 15 ELSE 0 END, 95) / 100.0 END"""


def _goes(a: str = "") -> str:
    strip = lambda c: f"regexp_replace({c}, '^{R.SPACE}+|{R.SPACE}+$', '', 'g')"
    end = f"regexp_replace({strip(a + 'st')}, '{W.CLOSERS.replace(chr(39), chr(39) * 2)}', '')"
    return _GOES.format(a=a, end=end, tt=strip(a + "tt"))


_REASON = """CASE WHEN sp = tp AND sb = tb THEN CASE WHEN sm = 'MULTI_COLUMN' AND sc <> tc THEN 'NEXT_COLUMN' ELSE 'SAME_COLUMN' END WHEN tm = 'SPANNING' AND sm <> 'SPANNING' THEN 'BEFORE_SPANNING_BLOCK' WHEN sm = 'SPANNING' AND tm <> 'SPANNING' THEN 'AFTER_SPANNING_BLOCK'
  WHEN sm = 'MULTI_COLUMN' AND tm = 'FULL_WIDTH' THEN 'BEFORE_SPANNING_BLOCK' WHEN sm = 'FULL_WIDTH' AND tm = 'MULTI_COLUMN' THEN 'AFTER_SPANNING_BLOCK' WHEN sp <> tp THEN CASE WHEN multi THEN 'NEXT_COLUMN' ELSE 'SAME_COLUMN' END
  WHEN sm = 'MULTI_COLUMN' AND tm = 'MULTI_COLUMN' THEN CASE WHEN abs(sx - tx) <= greatest(4, 0.02::DOUBLE * greatest(sw, tw)) THEN 'SAME_COLUMN' ELSE 'NEXT_COLUMN' END ELSE 'SAME_COLUMN' END"""


@query(f"""WITH {_FLOWED}, e AS (SELECT doc, source, target, {_REASON} AS r, {_goes()} AS c, CASE WHEN (sk IN ('FIGURE', 'TABLE') AND tl = 'CAPTION_LIKE') OR (tk IN ('FIGURE', 'TABLE') AND sl = 'CAPTION_LIKE') THEN 0.66 END AS k FROM ed),
main AS (SELECT doc, source, target, CASE WHEN c IS NOT NULL THEN 'CONTINUATION' WHEN k IS NOT NULL THEN 'CAPTION_ASSOCIATION' ELSE r END AS reason, round(coalesce(c, k, CASE r WHEN 'NEXT_COLUMN' THEN 0.85 WHEN 'SAME_COLUMN' THEN 0.9 ELSE 0.75 END), 4)::DOUBLE AS confidence FROM e),
lt AS (SELECT *, last_value(CASE WHEN kind = 'TEXT' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM fl),
far AS (SELECT t.doc, s.region AS source, t.region AS target, s.kind AS sk, t.kind AS tk, s.label AS sl, t.label AS tl, s.text AS st, t.text AS tt, s.w AS w, s.last_w AS lw FROM lt t JOIN fl s ON s.doc = t.doc AND s.pos = t.lp WHERE t.kind = 'TEXT' AND t.lp < t.pos - 1)
SELECT * FROM main UNION ALL SELECT doc, source, target, 'CONTINUATION', round({_goes()}, 4)::DOUBLE FROM far WHERE {_goes()} IS NOT NULL""")
def reading_edges(spark, sf):
    flow = _flow(spark, sf)
    # Each figure or table and a caption beside it in the flow are a pair.
    w = P.Window.partitionBy("doc").orderBy("pos")
    rows = flow.withColumn("_k", F.lag("kind").over(w)).withColumn("_l", F.lag("label").over(w)).withColumn("_r", F.lag("region").over(w))
    block = lambda c: F.col(c).isin("FIGURE", "TABLE")
    after = rows.where(block("_k") & (F.col("label") == "CAPTION_LIKE")).select(F.col("_r").alias("main"), F.col("region").alias("caption"))
    before = rows.where(block("kind") & (F.col("_l") == "CAPTION_LIKE")).select(F.col("region").alias("main"), F.col("_r").alias("caption"))
    edges = W.edges(flow, after.union(before).withColumn("score", F.lit(0.66)))
    return edges.select("doc", "source", "target", "reason", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {M.ctes('m_regions')}, n AS (SELECT doc, region, lead(region) OVER (PARTITION BY doc, page ORDER BY y, x, region) AS target FROM m_regions WHERE part % 4 = 1) SELECT doc, region AS source, target, 'FOOTNOTE_FLOW' AS reason, 0.8::DOUBLE AS confidence FROM n WHERE target IS NOT NULL")
def footnote_flow(spark, sf):
    return W.note_edges(M.df(spark, sf, "m_regions").where("part % 4 = 1"))


@query(f"""WITH {M.ctes('m_regions')}, a AS (SELECT doc, region, page, CASE WHEN part % 3 = 0 THEN 0 WHEN part % 3 = 1 THEN 1 ELSE 2 END AS turn, n FROM m_regions)
SELECT doc, region, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN turn = 2 THEN 1 ELSE 0 END, CASE WHEN turn = 2 THEN NULL ELSE page END, turn, CASE WHEN turn = 2 THEN region ELSE n END, region)::BIGINT AS position FROM a""")
def flow_nodes(spark, sf):
    rows = M.df(spark, sf, "m_regions").withColumn("pos", F.col("n"))
    return W.nodes(rows.where("part % 3 = 0"), rows.where("part % 3 IN (0, 1)"), rows.withColumn("pos", F.col("region")))


@query(f"WITH {M.ctes('m_regions', 'm_items')}, l AS (SELECT page AS region, n AS pos, text, x, CASE WHEN font > 9 THEN font ELSE h END AS font FROM m_regions WHERE page % 4 <> 1) SELECT region, sha256(string_agg(pos || '|' || text || '|' || round(x)::BIGINT || '|' || round(font)::BIGINT, ';' ORDER BY pos)) AS lines_sha, count(*) AS n_lines FROM l GROUP BY region")
def region_lines(spark, sf):
    items = M.df(spark, sf, "m_regions")
    regions = items.select(F.col("page").alias("region"), F.when(F.col("page") % 4 == 1, "FIGURE").otherwise("TEXT").alias("kind")).distinct()
    spans = items.select(F.col("region").alias("item"), "text", "x", "y", "w", "h", F.when(F.col("font") > 9, F.col("font")).otherwise(0.0).alias("font"))
    rows = V.region_lines(regions, items.select(F.col("page").alias("region"), F.col("n").alias("pos"), F.col("region").alias("item")), spans)
    said = F.transform("lines", lambda s: F.concat_ws("|", s["pos"].cast("string"), s["text"], F.round(s["x"]).cast("long").cast("string"), F.round(s["font"]).cast("long").cast("string")))
    return rows.select("region", F.sha2(F.array_join(said, ";"), 256).alias("lines_sha"), F.size("lines").cast("long").alias("n_lines"))


_NR = "nr AS (SELECT node, 0 AS pos, region FROM m_nodes WHERE region IS NOT NULL UNION ALL SELECT node, 1, region + 10 FROM m_nodes WHERE region % 2 = 0)"


def _bound(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    return nodes, nodes.where("region IS NOT NULL").select("node", F.lit(0).alias("pos"), "region").union(nodes.where("region % 2 = 0").select("node", F.lit(1), F.col("region") + 10))


@query(f"WITH {M.ctes('m_nodes')}, {_NR}, a AS (SELECT doc, node, string_agg(nr.region, ',' ORDER BY nr.pos) AS regions, sha256(concat_ws(chr(31), doc, 'source-anchor', node)) AS h FROM m_nodes JOIN nr USING (node) WHERE parent IS NOT NULL GROUP BY doc, node) SELECT node, {_ID} AS anchor, regions FROM a")
def source_anchors(spark, sf):
    return V.source_anchors(*_bound(spark, sf)).select("node", "anchor", F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"))


@query(f"""WITH {M.ctes('m_nodes', 'm_regions')}, {_NR}, f AS (SELECT nr.* FROM nr JOIN m_nodes n USING (node) WHERE n.kind = 'FIGURE'), o AS (SELECT region, k AS n, part + k AS object FROM m_regions, range(3) t(k)), m AS (SELECT node, object, min({{'p': f.pos, 'n': o.n}}) AS k FROM f JOIN o USING (region) WHERE object % 2 = 0 GROUP BY node, object),
i AS (SELECT node, list(object ORDER BY k, object) AS images FROM m GROUP BY node) SELECT node, array_to_string(CASE WHEN node % 3 = 0 THEN [node] ELSE [x FOR x IN images IF x % 4 = 0] END, ',') AS resources FROM i""")
def figure_resources(spark, sf):
    nodes, bound = _bound(spark, sf)
    figures = bound.join(nodes.where("kind = 'FIGURE'").select("node"), "node")
    objects = M.df(spark, sf, "m_regions").select("region", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"), "part").select("region", "n", (F.col("part") + F.col("n")).alias("object"))
    rows = V.figure_images(figures, objects, objects.where("object % 2 = 0").select("object"))
    fragment = F.when(F.col("node") % 3 == 0, F.col("node"))
    # A node without a fragment has no resource of its number, though an image may have that number.
    usable = F.concat(F.filter("images", lambda i: i % 4 == 0), F.array_compact(F.array(fragment)))
    return rows.select("node", F.array_join(V.shown_resources(F.col("images"), fragment, usable).cast("array<string>"), ",").alias("resources"))


_VIEW = f"""{M.ctes('m_nodes', 'm_regions')}, b AS (SELECT node, 0 AS b, 0 AS a, node * 2 AS anchor FROM m_nodes UNION ALL SELECT node, 1, 0, node * 2 + 1 FROM m_nodes WHERE node % 2 = 0), an AS (SELECT node * 2 AS anchor, 0 AS f, region FROM m_nodes WHERE region IS NOT NULL UNION ALL SELECT node * 2 + 1, k, region + 10 * k FROM m_nodes, range(2) t(k) WHERE region IS NOT NULL),
ren AS (SELECT node, 0 AS r, k AS f, pos % 3 + k AS page, 10::DOUBLE AS x, pos * 30::DOUBLE + k AS y, 50::DOUBLE AS w, 12::DOUBLE AS h FROM m_nodes, range(2) t(k) WHERE node % 5 <> 0 UNION ALL SELECT node, 1, 0, 4, 5, 7, 20, 10 FROM m_nodes WHERE node % 4 = 0 AND node % 5 <> 0),
src AS (SELECT b.node, 'source' AS side, r.page, r.x, r.y, r.w, r.h, row_number() OVER (PARTITION BY b.node ORDER BY b.a, an.f) AS n FROM b JOIN (SELECT node, max(b) AS b FROM b GROUP BY node) l USING (node, b) JOIN an USING (anchor) JOIN m_regions r USING (region)),
tgt AS (SELECT ren.node, 'target' AS side, page, x, y, w, h, row_number() OVER (PARTITION BY ren.node ORDER BY f) AS n FROM ren JOIN (SELECT node, max(r) AS r FROM ren GROUP BY node) l USING (node, r)), both_ AS (SELECT DISTINCT node FROM src INTERSECT SELECT DISTINCT node FROM tgt),
pairs AS (SELECT * FROM src WHERE node IN (SELECT node FROM both_) UNION ALL SELECT * FROM tgt WHERE node IN (SELECT node FROM both_))"""


def _pairs(spark, sf):
    nodes, regions = M.df(spark, sf, "m_nodes"), M.df(spark, sf, "m_regions")
    n = F.col("node")
    bindings = nodes.select("node", F.lit(0).alias("b"), F.lit(0).alias("a"), (n * 2).alias("anchor")).union(nodes.where("node % 2 = 0").select("node", F.lit(1), F.lit(0), n * 2 + 1))
    held = nodes.where("region IS NOT NULL")
    two = held.select((n * 2 + 1).alias("anchor"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("f"), "region").select("anchor", "f", F.col("region") + 10 * F.col("f"))
    anchors = held.select((n * 2).alias("anchor"), F.lit(0).alias("f"), "region").union(two)
    some = nodes.where("node % 5 <> 0")
    first = some.select("node", F.lit(0).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("f"), "pos").select("node", "r", "f", (F.col("pos") % 3 + F.col("f")).alias("page"), F.lit(10.0).alias("x"), (F.col("pos") * 30.0 + F.col("f")).alias("y"), F.lit(50.0).alias("w"), F.lit(12.0).alias("h"))
    again = some.where("node % 4 = 0").select("node", F.lit(1), F.lit(0), F.lit(4).cast("long"), F.lit(5.0), F.lit(7.0), F.lit(20.0), F.lit(10.0))
    return V.pairs(bindings, anchors, regions.select("region", "page", "x", "y", "w", "h"), first.union(again))


@query(f"WITH {_VIEW} SELECT node, side, page, n, round(x, 4) AS x, round(y, 4) AS y FROM pairs")
def viewer_pairs(spark, sf):
    return _pairs(spark, sf).select("node", "side", "page", F.col("n").cast("long").alias("n"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {_VIEW}, o AS (SELECT node, n AS origin, page % 8 AS page, y FROM pairs WHERE side = 'source'), t AS (SELECT node, page, y, n FROM pairs WHERE side = 'target')
SELECT o.origin::BIGINT AS origin, node, t.page, t.n::BIGINT AS n FROM o JOIN t USING (node) QUALIFY row_number() OVER (PARTITION BY node, origin ORDER BY CASE WHEN t.page >= o.page THEN 0 ELSE 1 END, t.page, abs(t.y - o.y), t.n) = 1""")
def counterpart_pick(spark, sf):
    rows = _pairs(spark, sf)
    origins = rows.where("side = 'source'").select(F.col("n").cast("long").alias("origin"), "node", (F.col("page") % 8).alias("page"), "y")
    return V.counterpart(origins, rows.where("side = 'target'")).select("origin", "node", "page", F.col("n").cast("long").alias("n"))


_POINTS = "pts AS (SELECT region AS point, page, x + 9 AS px, y + part % 40 AS py FROM m_regions WHERE n < 4), pc AS (SELECT page, region AS fragment, x, y, w, h FROM m_regions WHERE part % 9 <> 0)"


def _fragments(spark, sf):
    return M.df(spark, sf, "m_regions").where("part % 9 <> 0").select("page", F.col("region").alias("fragment"), "x", "y", "w", "h")


@query(f"WITH {M.ctes('m_regions')}, {_POINTS} SELECT point, fragment, row_number() OVER (PARTITION BY point ORDER BY round(w * h, 6), fragment)::BIGINT AS position FROM pts JOIN pc USING (page) WHERE px BETWEEN x AND x + w AND py BETWEEN y AND y + h AND px < 400 AND py < 500")
def hit_test(spark, sf):
    points = M.df(spark, sf, "m_regions").where("n < 4").select(F.col("region").alias("point"), "page", (F.col("x") + 9).alias("px"), (F.col("y") + F.col("part") % 40).alias("py"))
    return V.hits(points, _fragments(spark, sf), 400.0, 500.0)


@query(f"WITH {M.ctes('m_regions')}, {_POINTS}, sc AS (SELECT region AS point, page, CASE WHEN n % 3 = 0 THEN 0 ELSE 200 END AS sw, x AS cx, y AS cy FROM m_regions WHERE n < 3) SELECT point, fragment FROM (SELECT point, page, (cx - 10) / sw * 400 AS px, (cy - 20) / 250 * 500 AS py FROM sc WHERE sw > 0) JOIN pc USING (page) WHERE px >= 0 AND py >= 0 AND px < 400 AND py < 500 AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h QUALIFY row_number() OVER (PARTITION BY point ORDER BY round(w * h, 6), fragment) = 1")
def pointer_hits(spark, sf):
    """Pointers on a page shown 200 by 250 pixels at (10, 20), and on pages not shown."""
    lit = F.lit
    at = V.to_page(F.col("x"), F.col("y"), lit(10.0), lit(20.0), F.when(F.col("n") % 3 == 0, 0.0).otherwise(200.0), lit(250.0), lit(400.0), lit(500.0))
    points = M.df(spark, sf, "m_regions").where("n < 3").select(F.col("region").alias("point"), "page", at.alias("p")).where("p IS NOT NULL").select("point", "page", "p.*")
    return V.hits(points, _fragments(spark, sf), 400.0, 500.0).where("position = 1").drop("position")


@query(f"WITH {M.ctes('m_regions')}, {_POINTS}, bd AS (SELECT region AS band, page, y AS y_min, y + part % 60 AS y_max FROM m_regions WHERE n < 3) SELECT band, fragment, row_number() OVER (PARTITION BY band ORDER BY y, fragment)::BIGINT AS position FROM bd JOIN pc USING (page) WHERE y <= y_max AND y + h >= y_min")
def band_query(spark, sf):
    bands = M.df(spark, sf, "m_regions").where("n < 3").select(F.col("region").alias("band"), "page", F.col("y").alias("y_min"), (F.col("y") + F.col("part") % 60).alias("y_max"))
    return V.in_bands(bands, _fragments(spark, sf), 400.0, 500.0)


@query(f"""WITH {M.ctes('m_nodes')}, i AS (SELECT node AS issue, [node::VARCHAR, (node * 2 + 1)::VARCHAR, 'x'] AS affected FROM m_nodes WHERE pos % 2 = 0), ids AS (SELECT node, node::VARCHAR AS id FROM m_nodes UNION ALL SELECT node, (node * 2 + 21)::VARCHAR FROM m_nodes WHERE node % 3 = 0)
SELECT DISTINCT node, issue FROM (SELECT issue, unnest(affected) AS id FROM i) JOIN ids USING (id)""")
def issues_of_nodes(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    n = F.col("node")
    issues = nodes.where("pos % 2 = 0").select(n.alias("issue"), F.array(n.cast("string"), (n * 2 + 1).cast("string"), F.lit("x")).alias("affected"))
    return V.node_issues(issues, nodes, nodes.where("node % 3 = 0").select("node", (n * 2 + 21).alias("anchor")))


@query(f"WITH {M.ctes('m_nodes')}, r AS (SELECT node AS record, 'p@' || kind AS said FROM m_nodes WHERE node % 3 <> 0), n AS (SELECT node, unnest([node + 1, node, node - 1]) AS record, generate_subscripts([1, 2, 3], 1) AS pos FROM m_nodes) SELECT node, string_agg(said, ',' ORDER BY pos) AS said FROM n JOIN r USING (record) GROUP BY node")
def provenance_of_nodes(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    n = F.col("node")
    records = nodes.where("node % 3 <> 0").select(n.alias("record"), F.concat(F.lit("p@"), "kind").alias("said"))
    return V.node_records(nodes.select("node", F.array(n + 1, n, n - 1).alias("record_ids")), records).select("node", F.array_join("said", ",").alias("said"))


@query(f"""WITH {M.ctes('m_regions')} SELECT region, CASE part % 5 WHEN 0 THEN text WHEN 1 THEN array_to_string([text || ' ' || k FOR k IN range(least(20, 15 + n))], ' | ') || CASE WHEN 15 + n > 20 THEN '…' ELSE '' END WHEN 2 THEN 'Figure ' || CASE WHEN n % 2 = 0 THEN '7' ELSE '' END WHEN 3 THEN coalesce(CASE WHEN n % 2 = 0 THEN 'x^2' END, 'raw') ELSE '[preview]' END AS plain FROM m_regions""")
def node_plain_text(spark, sf):
    five, n = F.col("part") % 5, F.col("n")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), n + 14), lambda k: F.concat_ws(" ", "text", k.cast("string")))
    even = n % 2 == 0
    plain = V.plain_text(F.when(five == 0, F.col("text")), F.when(five == 1, cells), five == 2, F.when(even, "7"), [F.when((five == 3) & even, "x^2"), F.when(five == 3, "raw")])
    return M.df(spark, sf, "m_regions").select("region", plain.alias("plain"))


@query(f"""WITH {M.ctes('m_regions')}, m AS (SELECT region AS node, side, CASE side WHEN 'source' THEN text ELSE '[TRANSLATED] ' || text END AS text, CASE part % 3 WHEN 0 THEN 'CITATION' WHEN 1 THEN 'LINK' ELSE 'FOOTNOTE_REFERENCE' END AS type, n AS start, n + part % 30 AS stop, CASE WHEN part % 2 = 0 THEN '[' || n || ']' END AS label, supp AS target FROM m_regions, (VALUES ('source'), ('target')) v(side))
SELECT node, side, start, CASE WHEN stop <= length(text) THEN substr(text, start + 1, stop - start) ELSE '[out of range]' END AS slice, type || CASE WHEN label IS NOT NULL THEN ' ' || label ELSE '' END AS label, target FROM m WHERE type <> 'LINK'""")
def mark_slices(spark, sf):
    rows = M.df(spark, sf, "m_regions").withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    three = F.col("part") % 3
    marks = rows.select(
        F.col("region").alias("node"), "side", F.when(F.col("side") == "source", F.col("text")).otherwise(F.concat(F.lit("[TRANSLATED] "), "text")).alias("text"), F.when(three == 0, "CITATION").when(three == 1, "LINK").otherwise("FOOTNOTE_REFERENCE").alias("type"),
        F.col("n").alias("start"), (F.col("n") + F.col("part") % 30).alias("stop"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"))).alias("label"), F.col("supp").alias("target"),
    )
    return V.citation_slices(marks)


_JSON = f"""{M.ctes('m_nodes', 'm_relations')}, nj AS (SELECT doc, string_agg('{{"id":"' || node || '","kind":"' || kind || '"}}', ',' ORDER BY node) AS j FROM m_nodes GROUP BY doc), rj AS (SELECT doc, string_agg('{{"source":"' || source || '","target":"' || target || '"}}', ',' ORDER BY source, target) AS j FROM m_relations GROUP BY doc)"""


@query(f"""WITH {_JSON} SELECT d.doc, sha256('{{"viewerDataVersion":2,"semanticNodes":[' || coalesce(nj.j, '') || '],"semanticRelations":[' || coalesce(rj.j, '') || ']}}') AS bundle_sha FROM (SELECT DISTINCT doc FROM m_nodes) d LEFT JOIN nj USING (doc) LEFT JOIN rj USING (doc)""")
def viewer_bundle(spark, sf):
    nodes, relations = M.df(spark, sf, "m_nodes"), M.df(spark, sf, "m_relations")
    text = lambda c: F.col(c).cast("string").alias(c if c != "node" else "id")
    n = nodes.select("doc", F.struct("node").alias("pos"), F.to_json(F.struct(text("node"), "kind")).alias("json"))
    r = relations.select("doc", F.struct("source", "target").alias("pos"), F.to_json(F.struct(text("source"), text("target"))).alias("json"))
    return V.bundle(nodes, semanticNodes=n, semanticRelations=r).select("doc", F.sha2("json", 256).alias("bundle_sha"))


@query(f"""WITH {M.ctes('m_pages')} SELECT doc, CASE doc // 8 % 6 WHEN 0 THEN 'unsupported viewer data version' WHEN 1 THEN 'missing array issues' WHEN 2 THEN 'semantic node confidence' WHEN 3 THEN 'translation entry' WHEN 4 THEN 'invalid mapping bundle' END AS error FROM m_pages WHERE page = doc""")
def bundle_guard(spark, sf):
    six = F.expr("doc div 8") % 6
    arrays = F.lit(",".join(f'"{a}":[]' for a in V.ARRAYS if a not in {"issues", "semanticNodes"}))
    node = F.concat(F.lit('{"id":"a","kind":"PARAGRAPH","confidence":{'), F.when(six == 2, "").otherwise('"score":0.5'), F.lit("}}"))
    entry = F.when(six == 3, "{}").otherwise('{"semanticNodeId":"a"}')
    body = F.concat(F.lit('{"viewerDataVersion":'), F.when(six == 0, "1").otherwise("2"), F.lit(","), arrays, F.when(six == 1, "").otherwise(',"issues":[]'), F.lit(',"semanticNodes":['), node, F.lit('],"translation":{"entries":['), entry, F.lit("]}}"))
    return M.df(spark, sf, "m_pages").where("page = doc").select("doc", V.bundle_errors(F.when(six == 4, "[1").otherwise(body)).alias("error"))


@query(f"WITH {M.ctes('m_pages')}, r AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS i, page FROM m_pages) SELECT doc, i::BIGINT AS page_index, page FROM r")
def page_lookup(spark, sf):
    pages = M.df(spark, sf, "m_pages")
    rows = pages.select("doc", "page_index")
    return V.pages_at(rows, pages)


@query(f"WITH {M.ctes('m_regions')}, p AS (SELECT r.*, n % 2 AS side FROM m_regions r) SELECT page, side::BIGINT AS side, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(sum(greatest(0, least(y + h, 200) - greatest(y, 100))), 4) AS in_band FROM p GROUP BY page, side")
def item_boxes(spark, sf):
    """The box of the items of each column, and how much of a band they cover."""
    rows = M.df(spark, sf, "m_regions").withColumn("side", F.col("n") % 2)
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    shared = F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), F.lit(200.0)) - F.greatest("y", F.lit(100.0)))
    return rows.groupBy("page", "side").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.round(F.sum(shared), 4).alias("in_band"))


@query(f"""WITH {M.ctes('m_regions', 'm_bands')}, rg AS (SELECT doc, page, string_agg(region, ',' ORDER BY n) AS regions FROM m_regions GROUP BY doc, page), bd AS (SELECT own AS page, string_agg(band, ',' ORDER BY band) AS bands FROM m_bands GROUP BY own)
SELECT rg.doc, sha256(string_agg(rg.page || ':' || regions || ':' || coalesce(bands, ''), ';' ORDER BY rg.page)) AS layout_sha, count(*) AS n_pages FROM rg LEFT JOIN bd USING (page) GROUP BY rg.doc""")
def layout_documents(spark, sf):
    """Pages with their regions and bands, nested in one row a document."""
    listed = lambda c, order: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("_v")))), lambda s: s["_v"])
    regions = M.df(spark, sf, "m_regions").groupBy("doc", "page").agg(listed("region", "n").alias("regions"))
    bands = M.df(spark, sf, "m_bands").groupBy(F.col("own").alias("page")).agg(F.sort_array(F.collect_list("band")).alias("bands"))
    pages = regions.join(bands, "page", "left").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "regions", "bands"))).alias("pages"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    said = F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), text(p["regions"]), F.coalesce(text(p["bands"]), F.lit(""))))
    return pages.select("doc", F.sha2(F.array_join(said, ";"), 256).alias("layout_sha"), F.size("pages").cast("long").alias("n_pages"))


@query(f"""WITH {M.ctes('m_nodes')}, b AS (SELECT doc, string_agg(node, ',' ORDER BY node) AS nodes, count(*) AS n_bindings FROM m_nodes WHERE parent IS NOT NULL AND region IS NOT NULL GROUP BY doc)
SELECT doc, n_bindings, sha256(nodes) AS nodes_sha, substr(sha256(concat_ws(chr(31), doc, 'render-binding')), 1, 8) AS render_binding FROM b""")
def mapping_bundles(spark, sf):
    nodes = M.df(spark, sf, "m_nodes").where("parent IS NOT NULL AND region IS NOT NULL")
    own = F.array_join(F.sort_array(F.collect_list("node")).cast("array<string>"), ",")
    return nodes.groupBy("doc").agg(F.count("*").alias("n_bindings"), F.sha2(own, 256).alias("nodes_sha")).withColumn("render_binding", F.substring(V.stable(F.col("doc"), F.lit("render-binding")), 1, 8))
