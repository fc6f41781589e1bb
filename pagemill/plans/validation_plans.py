"""Queries over the integrity of the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from ..sources import model as M
from .registry import query


def _sql(names: list[str], rules: list[tuple[str, str]], more: str = "") -> str:
    """Union of rules: each a name and a query of its subject."""
    body = " UNION ALL ".join(f"SELECT '{rule}' AS rule, subject FROM ({q})" for rule, q in rules)
    return f"WITH {M.ctes(*names)}{more} {body}"


_PAGE_LISTS = ", page_regions AS (SELECT page, object AS region FROM m_page_objects), page_bands AS (SELECT own AS page, band FROM m_bands WHERE band % 41 <> 0)"


@query(_sql(["m_pages", "m_objects", "m_page_objects"], [
    ("page lists unknown object", "SELECT page || ' ' || object AS subject FROM m_page_objects WHERE object NOT IN (SELECT object FROM m_objects)"),
    ("listed object belongs to another page", "SELECT l.page || ' ' || l.object AS subject FROM m_page_objects l JOIN m_objects o USING (object) WHERE o.page <> l.page"),
    ("object on unknown page", "SELECT object::VARCHAR AS subject FROM m_objects WHERE page NOT IN (SELECT page FROM m_pages)"),
    ("object not listed by its page", "SELECT object::VARCHAR AS subject FROM m_objects o WHERE page IN (SELECT page FROM m_pages) AND NOT EXISTS (SELECT 1 FROM m_page_objects l WHERE l.page = o.page AND l.object = o.object)"),
]))
def physical_integrity(spark, sf):
    return V.physical(M.df(spark, sf, "m_pages"), M.df(spark, sf, "m_objects"), M.df(spark, sf, "m_page_objects"))


@query(_sql(["m_pages", "m_regions", "m_bands", "m_columns", "m_page_objects"], [
    ("page lists unknown region", "SELECT page || ' ' || region AS subject FROM page_regions WHERE region NOT IN (SELECT region FROM m_regions)"),
    ("page lists unknown band", "SELECT page || ' ' || band AS subject FROM page_bands WHERE band NOT IN (SELECT band FROM m_bands)"),
    ("listed band belongs to another page", "SELECT l.page || ' ' || l.band AS subject FROM page_bands l JOIN m_bands b USING (band) WHERE b.page <> l.page"),
    ("listed region belongs to another page", "SELECT l.page || ' ' || l.region AS subject FROM page_regions l JOIN m_regions b USING (region) WHERE b.page <> l.page"),
    ("region on unknown page", "SELECT region::VARCHAR AS subject FROM m_regions WHERE page NOT IN (SELECT page FROM m_pages)"),
    ("region not listed by its page", "SELECT region::VARCHAR AS subject FROM m_regions r WHERE page IN (SELECT page FROM m_pages) AND NOT EXISTS (SELECT 1 FROM page_regions l WHERE l.page = r.page AND l.region = r.region)"),
    ("band on unknown page", "SELECT band::VARCHAR AS subject FROM m_bands WHERE page NOT IN (SELECT page FROM m_pages)"),
    ("band not listed by its page", "SELECT band::VARCHAR AS subject FROM m_bands b WHERE page IN (SELECT page FROM m_pages) AND NOT EXISTS (SELECT 1 FROM page_bands l WHERE l.page = b.page AND l.band = b.band)"),
    ("band lists unknown column", "SELECT own || ' ' || (col + CASE WHEN col % 43 = 0 THEN 7000000 ELSE 0 END) AS subject FROM m_columns WHERE col + CASE WHEN col % 43 = 0 THEN 7000000 ELSE 0 END NOT IN (SELECT col FROM m_columns)"),
    ("column on unknown page", "SELECT col::VARCHAR AS subject FROM m_columns WHERE page NOT IN (SELECT page FROM m_pages)"),
    ("column of unknown band", "SELECT col::VARCHAR AS subject FROM m_columns WHERE band NOT IN (SELECT band FROM m_bands)"),
    ("band of column belongs to another page", "SELECT col::VARCHAR AS subject FROM m_columns c JOIN m_bands b USING (band) WHERE b.page <> c.page"),
    ("column lists unknown region", "SELECT col || ' ' || region AS subject FROM column_regions WHERE region NOT IN (SELECT region FROM m_regions) AND col IN (SELECT col FROM m_columns)"),
    ("region of column belongs to another page", "SELECT col || ' ' || l.region AS subject FROM column_regions l JOIN m_columns c USING (col) JOIN m_regions r ON r.region = l.region WHERE r.page <> c.page"),
], _PAGE_LISTS + ", column_regions AS (SELECT page * 4 + n % 4 AS col, region FROM m_regions)"))
def layout_integrity(spark, sf):
    regions, bands, columns = (M.df(spark, sf, t) for t in ("m_regions", "m_bands", "m_columns"))
    page_regions = M.df(spark, sf, "m_page_objects").select("page", F.col("object").alias("region"))
    page_bands = bands.where("band % 41 <> 0").select(F.col("own").alias("page"), "band")
    band_columns = columns.select(F.col("own").alias("band"), (F.col("col") + F.when(F.col("col") % 43 == 0, 7000000).otherwise(0)).alias("col"))
    column_regions = regions.select((F.col("page") * 4 + F.col("n") % 4).alias("col"), "region")
    return V.layout(M.df(spark, sf, "m_pages"), regions, bands, columns, page_regions, page_bands, band_columns, column_regions)


_GROUPS = ", members AS (SELECT region AS grp, CASE WHEN n % 3 = 0 THEN NULL ELSE page END AS page, region + CASE WHEN region % 47 = 0 THEN 4 ELSE 10 * (region % 2) END AS region FROM m_regions)"


@query(_sql(["m_regions"], [
    ("group has unknown member", "SELECT grp || ' ' || region AS subject FROM members WHERE region NOT IN (SELECT region FROM m_regions)"),
    ("member belongs to another page", "SELECT m.grp || ' ' || m.region AS subject FROM members m JOIN m_regions r USING (region) WHERE m.page IS NOT NULL AND r.page <> m.page"),
], _GROUPS))
def group_integrity(spark, sf):
    regions = M.df(spark, sf, "m_regions")
    moved = F.col("region") + F.when(F.col("region") % 47 == 0, 4).otherwise(10 * (F.col("region") % 2))
    members = regions.select(F.col("region").alias("grp"), F.when(F.col("n") % 3 != 0, F.col("page")).alias("page"), moved.alias("region"))
    return V.groups(members, regions)


_FLOW = """, nodes AS (SELECT region FROM m_regions WHERE region % 53 <> 0 UNION ALL SELECT region + 600000000 FROM m_regions WHERE region % 91 = 0), edges AS (SELECT region AS source, region + 1 AS target FROM m_regions),
ends AS (SELECT 'source' AS side, source AS region FROM edges UNION ALL SELECT 'target', target FROM edges), prim AS (SELECT region + CASE WHEN region % 87 = 0 THEN 600000000 ELSE 0 END AS region FROM m_regions WHERE kind <> 'FOOTNOTE')"""


@query(_sql(["m_regions"], [
    ("flow has unknown node", "SELECT region::VARCHAR AS subject FROM nodes WHERE region NOT IN (SELECT region FROM m_regions)"),
    ("edge has unknown end", "SELECT side || ' ' || region AS subject FROM ends WHERE region NOT IN (SELECT region FROM m_regions)"),
    ("end of edge is no node of the flow", "SELECT side || ' ' || region AS subject FROM ends WHERE region IN (SELECT region FROM m_regions) AND region NOT IN (SELECT region FROM nodes)"),
    ("primary flow has unknown region", "SELECT region::VARCHAR AS subject FROM prim WHERE region NOT IN (SELECT region FROM m_regions)"),
    ("region of primary flow is no node of the flow", "SELECT region::VARCHAR AS subject FROM prim WHERE region IN (SELECT region FROM m_regions) AND region NOT IN (SELECT region FROM nodes)"),
], _FLOW))
def flow_integrity(spark, sf):
    regions = M.df(spark, sf, "m_regions")
    nodes = regions.where("region % 53 <> 0").select("region").union(regions.where("region % 91 = 0").select(F.col("region") + 600000000))
    edges = regions.select(F.col("region").alias("source"), (F.col("region") + 1).alias("target"))
    primary = regions.where("kind <> 'FOOTNOTE'").select((F.col("region") + F.when(F.col("region") % 87 == 0, 600000000).otherwise(0)).alias("region"))
    return V.flow(regions, nodes, edges, primary)


@query(_sql(["m_objects", "m_pages"], [
    ("candidate on unknown page", "SELECT candidate::VARCHAR AS subject FROM cand WHERE page IS NOT NULL AND page NOT IN (SELECT page FROM m_pages)"),
    ("candidate of unknown parent", "SELECT candidate::VARCHAR AS subject FROM cand WHERE parent IS NOT NULL AND parent NOT IN (SELECT candidate FROM cand)"),
], ", cand AS (SELECT object AS candidate, CASE WHEN object % 9 = 0 THEN NULL ELSE page END AS page, CASE WHEN object % 4 = 0 THEN object + 1 END AS parent FROM m_objects)"))
def evidence_integrity(spark, sf):
    objects = M.df(spark, sf, "m_objects")
    candidates = objects.select(F.col("object").alias("candidate"), F.when(F.col("object") % 9 != 0, F.col("page")).alias("page"), F.when(F.col("object") % 4 == 0, F.col("object") + 1).alias("parent"))
    return V.evidence(candidates, M.df(spark, sf, "m_pages"))


@query(_sql(["m_nodes", "m_children"], [
    ("unknown parent", "SELECT node::VARCHAR AS subject FROM m_nodes WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM m_nodes)"),
    ("unknown child", "SELECT parent || ' ' || child AS subject FROM m_children WHERE child NOT IN (SELECT node FROM m_nodes)"),
    ("child names another parent", "SELECT c.parent || ' ' || c.child AS subject FROM m_children c JOIN m_nodes n ON n.node = c.child WHERE n.parent IS DISTINCT FROM c.parent"),
    ("not listed by its parent", "SELECT node::VARCHAR AS subject FROM m_nodes n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_children c WHERE c.parent = n.parent AND c.child = n.node)"),
    ("child listed more than once", "SELECT parent || ' ' || child AS subject FROM m_children GROUP BY parent, child HAVING count(*) > 1"),
    ("child of several parents", "SELECT child::VARCHAR AS subject FROM m_children GROUP BY child HAVING count(DISTINCT parent) > 1"),
]))
def tree_integrity(spark, sf):
    return V.tree(M.df(spark, sf, "m_nodes"), M.df(spark, sf, "m_children"))


_FIT = "(type = 'CAPTION_OF' AND kind IN ('FIGURE', 'TABLE')) OR (type = 'CITES' AND kind = 'BIBLIOGRAPHY_ENTRY') OR (type = 'FOOTNOTE_OF' AND kind IN ('PARAGRAPH', 'UNKNOWN'))"


@query(_sql(["m_nodes", "m_relations"], [
    ("relation from unknown node", "SELECT type || ' ' || source AS subject FROM m_relations WHERE source NOT IN (SELECT node FROM m_nodes)"),
    ("relation to unknown node", "SELECT type || ' ' || target AS subject FROM m_relations WHERE target NOT IN (SELECT node FROM m_nodes)"),
    ("target of unexpected kind", f"SELECT CASE WHEN type = 'CITES' THEN 'CITATION_RESOLUTION' ELSE 'SOURCE_MAPPING' END || ' ' || type || ' ' || source || ' ' || target AS subject FROM m_relations r LEFT JOIN m_nodes n ON n.node = r.target WHERE NOT coalesce({_FIT}, false)"),
]))
def relation_integrity(spark, sf):
    nodes, relations = M.df(spark, sf, "m_nodes"), M.df(spark, sf, "m_relations")
    return V.all_of([V.ends(relations, nodes), V.targets(relations, nodes, V.RELATION_TARGETS, "source", "target")])


@query(_sql(["m_nodes"], [
    ("target of unexpected kind", "SELECT CASE WHEN type = 'CITATION' THEN 'CITATION_RESOLUTION' ELSE 'SOURCE_MAPPING' END || ' ' || type || ' ' || m.node || ' ' || target AS subject FROM marks m LEFT JOIN m_nodes n ON n.node = m.target WHERE type <> 'LINK' AND NOT coalesce((type = 'CITATION' AND kind = 'BIBLIOGRAPHY_ENTRY') OR (type = 'FOOTNOTE_REFERENCE' AND kind = 'FOOTNOTE'), false)"),
], ", marks AS (SELECT node, node + pos % 3 AS target, CASE pos % 3 WHEN 0 THEN 'LINK' WHEN 1 THEN 'CITATION' ELSE 'FOOTNOTE_REFERENCE' END AS type FROM m_nodes WHERE kind = 'PARAGRAPH')"))
def mark_integrity(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    kind = F.when(F.col("pos") % 3 == 0, "LINK").when(F.col("pos") % 3 == 1, "CITATION").otherwise("FOOTNOTE_REFERENCE")
    marks = nodes.where("kind = 'PARAGRAPH'").select("node", (F.col("node") + F.col("pos") % 3).alias("target"), kind.alias("type"))
    return V.targets(marks, nodes.select("node", "kind"), V.MARK_TARGETS, "node", "target")


_BOUND = ", ".join(f"'{k}'" for k in V.BOUND_KINDS)


@query(_sql(["m_nodes", "m_regions"], [
    ("no source regions", f"SELECT kind || ' ' || node AS subject FROM m_nodes WHERE kind IN ({_BOUND}) AND region IS NULL"),
    ("unknown source region", f"SELECT node || ' ' || region AS subject FROM m_nodes WHERE kind IN ({_BOUND}) AND region IS NOT NULL AND region NOT IN (SELECT region FROM m_regions)"),
]))
def binding_issues(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    return V.bindings(nodes, nodes.where("region IS NOT NULL").select("node", "region"), M.df(spark, sf, "m_regions"))


@query(_sql(["m_nodes", "m_relations"], [("caption of nothing", "SELECT CASE kind WHEN 'TABLE_CAPTION' THEN 'TABLE_RECOVERY' ELSE 'FIGURE_RECOVERY' END || ' ' || node AS subject FROM m_nodes WHERE kind IN ('FIGURE_CAPTION', 'TABLE_CAPTION') AND node NOT IN (SELECT source FROM m_relations WHERE type = 'CAPTION_OF')")]))
def caption_links(spark, sf):
    return V.captions(M.df(spark, sf, "m_nodes"), M.df(spark, sf, "m_relations"))


_DOCS = """, docs AS (SELECT doc, doc AS physical, CASE WHEN doc % 11 = 0 THEN doc + 1 ELSE doc END AS layout_of, doc AS layout, CASE WHEN doc % 7 = 0 THEN doc + 1 WHEN doc % 5 <> 0 THEN doc END AS semantic_of, doc AS semantic,
  doc % 3 <> 0 AS translated, CASE WHEN doc % 13 = 0 THEN NULL ELSE doc END AS translation_of, doc % 2 = 0 AS rendered, doc + doc % 10 / 8 AS render_of, doc AS translation, doc + 8 AS rendered_translation FROM m_pages WHERE page = doc)"""


@query(_sql(["m_pages"], [
    ("layout of another physical document", "SELECT doc::VARCHAR AS subject FROM docs WHERE layout_of <> physical"),
    ("semantics of another layout", "SELECT doc::VARCHAR AS subject FROM docs WHERE semantic_of <> layout"),
    ("translation of other semantics", "SELECT doc::VARCHAR AS subject FROM docs WHERE translated AND translation_of IS DISTINCT FROM semantic"),
    ("rendering of other semantics", "SELECT doc::VARCHAR AS subject FROM docs WHERE rendered AND render_of <> semantic"),
    ("rendering of another translation", "SELECT doc::VARCHAR AS subject FROM docs WHERE rendered AND translated AND rendered_translation <> translation"),
], _DOCS.replace("doc + doc % 10 / 8", "doc + doc % 10 // 8")))
def document_chain(spark, sf):
    doc = F.col("doc")
    docs = M.df(spark, sf, "m_pages").where("page = doc").select(
        doc, doc.alias("physical"), F.when(doc % 11 == 0, doc + 1).otherwise(doc).alias("layout_of"), doc.alias("layout"), F.when(doc % 7 == 0, doc + 1).when(doc % 5 != 0, doc).alias("semantic_of"), doc.alias("semantic"),
        (doc % 3 != 0).alias("translated"), F.when(doc % 13 != 0, doc).alias("translation_of"), (doc % 2 == 0).alias("rendered"), F.expr("doc + doc % 10 div 8").alias("render_of"), doc.alias("translation"), (doc + 8).alias("rendered_translation"),
    )
    return V.chain(docs)


@query(_sql(["m_regions", "m_nodes"], [
    ("semantic key in layout", "SELECT region || ' section' AS subject FROM m_regions WHERE part % 17 = 0"),
    ("semantic label in layout", "SELECT region || ' CITATION' AS subject FROM m_regions WHERE part % 19 = 0"),
    ("geometry key in semantics", "SELECT node || ' Page' AS subject FROM m_nodes WHERE node % 23 = 0 UNION ALL SELECT node || ' the_bbox' FROM m_nodes WHERE node % 29 = 0"),
]))
def layer_separation(spark, sf):
    regions, nodes = M.df(spark, sf, "m_regions"), M.df(spark, sf, "m_nodes")
    more = F.when(F.col("part") % 17 == 0, F.lit(', "section": 2')).otherwise("")
    json = F.concat(F.lit('{"id": "r", "geometry": {"x": 1}'), more, F.lit("}"))
    labels = F.when(F.col("part") % 19 == 0, F.array(F.lit("TEXT"), F.lit("CITATION"))).otherwise(F.array("label"))
    inner = F.concat(F.when(F.col("node") % 23 == 0, F.lit('"Page": 1, ')).otherwise(""), F.when(F.col("node") % 29 == 0, F.lit('"the_bbox" : [1], ')).otherwise(""))
    attributes = F.concat(F.lit('{"level": 1, "deep": [{'), inner, F.lit('"pages": "of page"}]}'))
    return V.layers_apart(regions.select("region", json.alias("json"), labels.alias("labels")), nodes.select("node", attributes.alias("attributes")))


@query(f"""WITH {M.ctes("m_nodes")}, b AS (SELECT node, kind, pos % 3 AS n_resources, pos % 2 = 0 AS has_caption, CASE WHEN pos % 5 < 3 THEN 'SOURCE' ELSE 'ABOVE' END AS cp, CASE WHEN pos % 4 = 1 THEN 'MULTILINE' ELSE 'SCALE_DOWN' END AS le FROM m_nodes)
SELECT node, 'multi-figure-layout' AS rule, 'stacked includegraphics' AS fallback FROM b WHERE kind = 'FIGURE' AND n_resources > 1 UNION ALL SELECT node, 'caption-source-figure', 'BELOW' FROM b WHERE kind = 'FIGURE' AND has_caption AND cp = 'SOURCE'
UNION ALL SELECT node, 'caption-source-table', 'ABOVE' FROM b WHERE kind = 'TABLE' AND has_caption AND cp = 'SOURCE' UNION ALL SELECT node, 'equation-multiline', 'SCALE_DOWN' FROM b WHERE kind = 'EQUATION' AND le = 'MULTILINE'""")
def render_policy_issues(spark, sf):
    pos = F.col("pos")
    blocks = M.df(spark, sf, "m_nodes").select("node", "kind", (pos % 3).alias("n_resources"), (pos % 2 == 0).alias("has_caption"), F.when(pos % 5 < 3, "SOURCE").otherwise("ABOVE").alias("caption_position"), F.when(pos % 4 == 1, "MULTILINE").otherwise("SCALE_DOWN").alias("long_equation"))
    return V.policy_issues(blocks)


@query(f"""WITH {M.ctes("m_regions")}, i AS (SELECT doc, region AS seq, 'CITATION_RESOLUTION' AS category, 'unresolved citation [' || part % 5 || ']' AS message FROM m_regions WHERE kind = 'TEXT')
SELECT doc, min(seq) AS seq, category, message, substr(sha256(concat_ws(chr(31), doc, 'issue', category, message)), 1, 32) AS issue_id FROM i GROUP BY doc, category, message""")
def issue_dedupe(spark, sf):
    rows = M.df(spark, sf, "m_regions").where("kind = 'TEXT'")
    message = F.concat(F.lit("unresolved citation ["), (F.col("part") % 5).cast("string"), F.lit("]"))
    return V.once(rows.select("doc", F.col("region").alias("seq"), F.lit("CITATION_RESOLUTION").alias("category"), message.alias("message")))
