"""Queries through the adapters, over dumps written from the derived views, and more small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources import adapters as A
from ..sources import derive as D
from ..sources import model as M
from ..sources import scan as P
from .layout_plans import _FONT, _ZONED, _zoned
from .registry import query


@query(f"WITH {D.BOXES} SELECT page, box_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, lower(label) AS label, 0.8::DOUBLE AS confidence FROM d_boxes")
def docling_adapter(spark, sf):
    """Boxes written with a bottom-left origin and read back."""
    b = D.boxes(spark, sf)
    height = 1000.0
    bbox = F.struct(F.col("x").alias("l"), (F.lit(height) - F.col("y")).alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.lit(height) - F.col("y") - F.col("h")).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    text = F.struct(F.lower("label").alias("label"), F.col("box_id").cast("string").alias("text"), F.array(F.struct(F.lit(1).alias("page_no"), bbox.alias("bbox"))).alias("prov"))
    dumps = b.groupBy("page").agg(F.to_json(F.struct(F.collect_list(text).alias("texts"))).alias("json"))
    rows = A.docling_regions(dumps.withColumnRenamed("page", "doc_id"), height)
    return rows.select(F.col("doc_id").alias("page"), F.col("text").cast("long").alias("box_id"), *(F.round(c, 6).alias(c) for c in "xywh"), "label", "confidence")


@query(f"WITH {D.BOXES} SELECT page, box_id, round(w, 6) AS w, round(h, 6) AS h, CASE WHEN label = 'TABLE' THEN 0.8 ELSE 0.82 END::DOUBLE AS confidence FROM d_boxes WHERE label <> 'FIGURE'")
def block_adapter(spark, sf):
    """Blocks by corners; figures have no box in the dump, so they are dropped."""
    b = D.boxes(spark, sf)
    corners = F.when(F.col("label") != "FIGURE", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    block = F.struct(F.when(F.col("label") == "TABLE", "equation").otherwise("text").alias("type"), corners.alias("bbox"), F.col("box_id").cast("string").alias("text"))
    dumps = b.groupBy("page").agg(F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.collect_list(block).alias("para_blocks"))).alias("pdf_info"))).alias("json"))
    rows = A.block_regions(dumps.withColumnRenamed("page", "doc_id"))
    return rows.select(F.col("doc_id").alias("page"), F.col("text").cast("long").alias("box_id"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "confidence")


@query(f"WITH {D.BOXES} SELECT page, box_id, page % 3 AS on_page, 'FORMULA' AS type, 'x' || box_id AS text, 0.8::DOUBLE AS confidence FROM d_boxes WHERE label = 'TABLE' UNION ALL SELECT page, box_id, page % 3, 'REGION', 'a ' || box_id, 0.82 FROM d_boxes WHERE label = 'TEXT'")
def block_layouts(spark, sf):
    """The three layouts of dumps: pages (here the second or third is the one with blocks), a middle part, and bare blocks, whose pages are the first."""
    b = D.boxes(spark, sf)
    n = F.col("box_id").cast("string")
    corners = F.when(F.col("label") != "FIGURE", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    lines = F.array(F.struct(F.array(F.struct(F.lit("a").alias("content")), F.struct(n.alias("content"))).alias("spans")))
    formula = F.col("label") == "TABLE"
    block = F.struct(F.when(formula, "display_formula").alias("type"), F.when(~formula, "text").alias("label"), corners.alias("bbox"), F.when(formula, F.concat(F.lit(" x"), n)).alias("latex"), F.when(~formula, lines).alias("lines"), n.alias("mathml"))
    held = b.groupBy("page").agg(F.collect_list(block).alias("blocks"))
    three = F.col("page") % 3
    page = lambda i, blocks: F.struct(F.lit(i).alias("page_idx"), blocks.alias("para_blocks"))
    json = F.when(three == 0, F.to_json(F.struct(F.col("blocks").alias("para_blocks")))).when(three == 1, F.to_json(F.struct(F.array(page(0, F.slice("blocks", 1, 0)), page(1, F.col("blocks"))).alias("pdf_info")))).otherwise(F.to_json(F.struct(F.array(page(2, F.col("blocks"))).alias("pdf_info"))))
    rows = A.block_regions(held.select(F.col("page").alias("doc_id"), json.alias("json")))
    number = F.regexp_extract("text", "([0-9]+)$", 1).cast("long")
    return rows.select(F.col("doc_id").alias("page"), number.alias("box_id"), F.col("page").alias("on_page"), "type", "text", "confidence")


@query("""SELECT r_regionkey::BIGINT AS doc_id, 'title' AS name, r_name AS value FROM region UNION ALL SELECT n_regionkey, 'author', string_agg(n_name, ', ' ORDER BY n_name) FROM nation GROUP BY n_regionkey""")
def scholarly_adapter(spark, sf):
    names = D.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("authors"))
    dumps = D.table(spark, sf, "region").join(names, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.to_json(F.struct(F.col("r_name").alias("title"), "authors")).alias("json"))
    return A.scholarly_metadata(dumps)


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'ABSTRACT' WHEN 1 THEN 'REFERENCES' ELSE 'SECTION' END AS role, (p_size % 3)::BIGINT AS page, p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN p_size END::DOUBLE AS x FROM part")
def scholarly_sections(spark, sf):
    p = F.col("p_partkey")
    section = F.struct(F.when(p % 4 == 0, " Abstract").when(p % 4 == 1, "bibliography").when(p % 4 == 2, "odd").otherwise("").alias("role"), F.col("p_name").alias("text"), (F.col("p_size") % 3).alias("page_idx"), F.when(p % 2 == 0, F.array(F.col("p_size"), F.lit(1), F.lit(9), F.lit(9))).alias("bbox"))
    dumps = D.table(spark, sf, "part").select(p.alias("doc_id"), F.to_json(F.struct(F.array(section).alias("sections"))).alias("json"))
    return A.scholarly_sections(dumps).select("doc_id", "role", "page", "text", "x")


@query("""SELECT r_regionkey::BIGINT AS doc_id, 'title' AS name, r_name AS value FROM region UNION ALL SELECT n_regionkey, 'head', n_name FROM nation UNION ALL SELECT r_regionkey, 'author', 'Ann A ' || r_name || ', B & C' FROM region
UNION ALL SELECT r_regionkey, 'abstract', 'Of ' || r_name FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, 'references', 'References' FROM region WHERE r_regionkey % 2 = 1""")
def tei_adapter(spark, sf):
    heads = D.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<div><head>"), "n_name", F.lit("</head></div>")))).alias("body"))
    name = F.concat(F.lit("<persName><forename>Ann</forename> <forename>A</forename><surname>"), "r_name", F.lit("</surname></persName><persName>B &amp; C</persName>"))
    even = F.col("r_regionkey") % 2 == 0
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), "r_name", F.lit("</title></titleStmt><sourceDesc>"), name, F.lit("</sourceDesc></fileDesc>"),
        F.when(even, F.concat(F.lit("<profileDesc><abstract><p>Of</p><p>"), "r_name", F.lit("</p></abstract></profileDesc>"))).otherwise(""), F.lit("</teiHeader><text><body>"), "body", F.lit("</body>"), F.when(~even, "<back><listBibl/></back>").otherwise(""), F.lit("</text></TEI>"),
    )
    return A.tei_metadata(D.table(spark, sf, "region").join(heads, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("doc_id"), xml.alias("xml")))


@query(f"""WITH {M.ctes('m_regions')}, t AS (SELECT page, n, part, text FROM m_regions) SELECT page AS doc, 0::BIGINT AS tab, n AS row, part % 3 AS col, 1 + part % 2 AS row_span, 1::BIGINT AS col_span, text FROM t WHERE page % 2 = 0
UNION ALL SELECT DISTINCT page, 0, 0, 0, 1, 2, 'wide' FROM t WHERE page % 2 = 1 UNION ALL SELECT DISTINCT page, 0, 1, x, 1, 1, 'c' || x FROM t, range(2) r(x) WHERE page % 2 = 1""")
def docling_cells(spark, sf):
    """Cells that a dump lists, and those of a grid whose first cell is two columns wide and stands in both."""
    return A.table_cells(_tables(spark, sf))


@query(f"""WITH {M.ctes('m_regions')} SELECT page AS doc, 0::BIGINT AS tab, page % 5 AS page, 5::DOUBLE AS x, 700::DOUBLE AS y, CASE WHEN page % 2 = 1 THEN 2 WHEN page % 4 = 0 THEN 77 ELSE max(n + 1 + part % 2) END::BIGINT AS n_rows, CASE WHEN page % 2 = 1 THEN 2 ELSE max(part % 3 + 1) END::BIGINT AS n_columns FROM m_regions GROUP BY page""")
def docling_tables(spark, sf):
    return A.docling_tables(_tables(spark, sf), 800.0).select("doc", "tab", "page", "x", "y", "n_rows", "n_columns")


def _tables(spark, sf):
    p, n = F.col("part"), F.col("n")
    cell = F.struct(n.alias("start_row_offset_idx"), (p % 3).cast("string").alias("column"), (n + 1 + p % 2).cast("double").alias("end_row_offset_idx"), F.lit(True).alias("col_span"), "text")
    own = M.df(spark, sf, "m_regions").groupBy("page").agg(F.collect_list(cell).alias("cells"))
    wide = F.struct(F.lit(0).alias("start_row_offset_idx"), F.lit(0).alias("start_col_offset_idx"), F.lit(2).alias("col_span"), F.lit("wide").alias("text"))
    small = lambda x: F.struct(F.lit(None).cast("int").alias("start_row_offset_idx"), F.lit(None).cast("int").alias("start_col_offset_idx"), F.lit(None).cast("int").alias("col_span"), F.lit(f"c{x}").alias("text"))
    place = F.array(F.struct((F.col("page") % 5 + 1).alias("page_no"), F.struct(F.lit(5).alias("l"), F.lit(100).alias("t"), F.lit(50).alias("r"), F.lit(10).alias("b"), F.lit("bottom-left").alias("coord_origin")).alias("bbox")))
    listed = F.to_json(F.struct(F.array(F.struct(place.alias("prov"), F.struct(F.col("cells").alias("table_cells"), F.when(F.col("page") % 4 == 0, "77").alias("num_rows")).alias("data"))).alias("tables")))
    grid = F.to_json(F.struct(F.array(F.struct(place.alias("prov"), F.array(F.array(wide, wide), F.array(small(0), small(1))).alias("grid"))).alias("tables")))
    return own.select(F.col("page").alias("doc_id"), F.when(F.col("page") % 2 == 0, listed).otherwise(grid).alias("json"))


# Each fourth box on a page turned by a further quarter; displayed pages are 560 by 600.
_TURN = "CASE box_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"


@query(f"""WITH {D.BOXES}, r AS (SELECT page, box_id, {_TURN.format('x', 'y', '560 - x - w', '560 - y - h')} AS x, {_TURN.format('600 - y - h', 'x', 'y', '600 - x - w')} AS y, {_TURN.format('w', 'h', 'w', 'h')} AS w, {_TURN.format('h', 'w', 'h', 'w')} AS h FROM d_boxes)
SELECT page, box_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM r""")
def rotated_pages(spark, sf):
    """Raw boxes to pages as they are shown: the affine map of all corners by the page's rotation, and the box around them."""
    raw = G.to_page(F.struct("x", "y", "w", "h"), F.col("box_id") % 4 * 90, F.lit(560.0), F.lit(600.0))
    return D.boxes(spark, sf).select("page", "box_id", raw.alias("r")).select("page", "box_id", *(F.round(f"r.{c}", 6).alias(c) for c in "xywh"))


@query(f"WITH {D.BOXES} SELECT page, box_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM d_boxes")
def unrotated_boxes(spark, sf):
    """Boxes shown and taken back to raw coordinates are the same."""
    turn = F.col("box_id") % 4 * 90
    there = G.to_page(F.struct("x", "y", "w", "h"), turn, F.lit(560.0), F.lit(600.0))
    rows = D.boxes(spark, sf).select("page", "box_id", there.alias("r")).select("page", "box_id", G.to_page(F.col("r"), turn, F.lit(560.0), F.lit(600.0), back=True).alias("r"))
    return rows.select("page", "box_id", *(F.round(f"r.{c}", 6).alias(c) for c in "xywh"))


@query(f"""WITH {D.SPANS}, {_FONT}, {_ZONED} SELECT doc_id, page, zone, line_no, row_number() OVER (PARTITION BY doc_id, page, zone ORDER BY y, x, line_no)::BIGINT AS position, 0.7::DOUBLE AS confidence FROM zoned WHERE zone <> 'body'""")
def furniture_regions(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page", "zone").orderBy("y", "x", "line_no")
    return _zoned(spark, sf).where("zone <> 'body'").select("doc_id", "page", "zone", "line_no", F.row_number().over(w).cast("long").alias("position"), F.lit(0.7).alias("confidence"))


@query("SELECT conv_id, sha256(concat_ws(chr(10) || chr(10), 'Translate.', max(CASE WHEN role = 'system' THEN text END), arg_min(text, turn) FILTER (role = 'user'))) AS prompt_sha FROM conversations GROUP BY conv_id")
def prompt_assembly(spark, sf):
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    rows = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"), first.alias("user"))
    return rows.select("conv_id", F.sha2(F.concat_ws("\n\n", F.lit("Translate."), "system", "user"), 256).alias("prompt_sha"))


@query(f"WITH {D.SPANS}, c AS (SELECT doc_id, page, count(*) AS n FROM d_spans GROUP BY doc_id, page) SELECT doc_id, page AS fullest_page, n AS n_spans FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page) = 1")
def fullest_page(spark, sf):
    counts = D.spans(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("page")).alias("p"))).alias("b"))
    return best.select("doc_id", (-F.col("b.p")).alias("fullest_page"), F.col("b.n").alias("n_spans"))


def _pages(b):
    return b.select("page").distinct().select(F.lit("f0").alias("source"), "page", F.lit(560.0).alias("width"), F.lit(600.0).alias("height"), (F.col("page") % 4 * 90).alias("rotation"))


@query(f"""WITH {D.BOXES}, kept AS (SELECT page, box_id, CASE WHEN label = 'FIGURE' THEN 'image' ELSE 'vector' END AS kind, x, y, w, h FROM d_boxes WHERE label <> 'TEXT' AND box_id % 20 <= 16 AND box_id % 7 <> 0 AND w > 0 AND h > 0),
n AS (SELECT *, (row_number() OVER (PARTITION BY page, kind ORDER BY box_id) - 1)::BIGINT AS n FROM kept),
i AS (SELECT *, sha256(concat_ws(chr(31), 'f0', kind, page, n)) AS s FROM n)
SELECT page, box_id, kind, n, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21, 12) AS object, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM (
  SELECT i.* REPLACE (CASE page % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 560 - x - w ELSE 560 - y - h END AS x, CASE page % 4 WHEN 0 THEN 600 - y - h WHEN 1 THEN x WHEN 2 THEN y ELSE 600 - x - w END AS y,
    CASE WHEN page % 2 = 1 THEN h ELSE w END AS w, CASE WHEN page % 2 = 1 THEN w ELSE h END AS h) FROM i)""")
def drawn_objects(spark, sf):
    """Figures as images, tables as paths, others as forms; some too deep, some without a height."""
    b = D.boxes(spark, sf)
    kind = F.when(F.col("label") == "FIGURE", "image").when(F.col("label") == "TEXT", "form").otherwise("path")
    top = F.col("y") + F.when(F.col("box_id") % 7 == 0, 0.0).otherwise(F.col("h"))
    rows = b.select(F.lit("f0").alias("source"), "page", F.col("box_id").alias("seq"), (F.col("box_id") % 20).alias("depth"), kind.alias("type"), F.col("x").alias("left"), F.col("y").alias("bottom"), (F.col("x") + F.col("w")).alias("right"), top.alias("top"))
    found = P.drawn(rows, _pages(b))
    number = F.row_number().over(Window.partitionBy("page", "kind").orderBy("box_id")).cast("long") - 1
    named = rows.where("type <> 'form' AND depth <= 16 AND top > bottom AND right > left").select("page", F.when(F.col("type") == "image", "image").otherwise("vector").alias("kind"), F.col("seq").alias("box_id")).withColumn("n", number)
    return found.join(named, ["page", "kind", "n"]).select("page", "box_id", "kind", "n", "object", *(F.round(c, 6).alias(c) for c in "xywh"))


@query()
def physical_objects(spark, sf):
    """Rectangles of text side by side with characters at five points each and a wide gap after each eighth, and the boxes as drawn objects."""
    # Lines by page, as the boxes' numbers need them too: all that follows is where its page is.
    r = M.df(spark, sf, "m_regions", lineitem=D.table(spark, sf, "lineitem").repartition("l_orderkey"))
    left = F.col("n") * 400 + F.col("part") % 9
    rects = r.select(F.lit("f0").alias("source"), "page", F.col("n").alias("rect"), left.cast("double").alias("left"), (F.col("part") % 5 * 3).cast("double").alias("bottom"), (left + 390).cast("double").alias("right"), (F.col("part") % 5 * 3 + 10).cast("double").alias("top"), "text")
    each = lambda c: F.array_repeat(c, F.length("text"))
    x = F.transform(each(F.col("left")), lambda c, i: c + i * 5 + F.floor(i / 8) * 31)
    chars = rects.select("source", "page", "rect", F.lit(0).alias("seq"), F.col("text").alias("char"), x.alias("x"), each(F.lit(5.0)).alias("w"))
    b = D.boxes(spark, sf)
    objects = b.select(F.lit("f0").alias("source"), "page", F.col("box_id").alias("seq"), F.lit(1).alias("depth"), F.when(F.col("label") == "FIGURE", "image").otherwise("path").alias("type"), F.col("x").alias("left"), F.col("y").alias("bottom"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("top"))
    # Regions are on the same pages.
    pages = _pages(b)
    return P.physical_objects(rects, chars, objects, pages)
