"""Queries over the recovery of semantic nodes from regions, on the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import semantics as S
from ..operators import structure as P
from ..operators import tree as T
from ..sources import model as M
from .registry import query
from .rule_plans import _HEAD, _S, _cited, _notes, _strip


def _flow(spark, sf):
    """Regions in reading order, by page and place in it."""
    return M.df(spark, sf, "m_regions").withColumn("pos", F.col("page_index") * 10 + F.col("n"))


_FLOW = f"{_S}, flow AS (SELECT *, page_index * 10 + n AS pos FROM s)"


@query()
def front_matter(spark, sf):
    flow = _flow(spark, sf)
    return S.front_matter(flow.where("page_index = 0"))


@query()
def front_confirmed(spark, sf):
    flow = _flow(spark, sf).where("page_index = 0")
    metadata = flow.select("doc").distinct().select("doc", F.lit("The rings of this  press").alias("title"), F.lit("Jane Q.").alias("author"))
    return S.confirmed(flow.select("doc", "pos", "text"), S.front_matter(flow), metadata)


@query()
def display_equations(spark, sf):
    rows = _flow(spark, sf).where("kind <> 'FOOTNOTE'").select("doc", "pos", "text", "label", (F.col("n") % 5).alias("n_lines"), (F.col("part") % 3 > 0).alias("goes_on"))
    return S.equations(rows)


@query(f"""WITH {_FLOW}, m AS (SELECT page, pos, s, region FROM flow WHERE part % 26 IN (5, 6, 20)), g AS (SELECT page, string_agg(s, ' ' ORDER BY pos) FILTER (s <> '' AND NOT regexp_matches(s, '^\\(\\p{{Nd}}{{1,3}}\\)$')) AS raw, arg_max(s, pos) AS last, arg_min(s, pos) AS first FROM m GROUP BY page),
n AS (SELECT *, coalesce(nullif(regexp_extract(last, '^\\((\\p{{Nd}}{{1,3}})\\)$', 1), ''), nullif(regexp_extract(first, '^\\((\\p{{Nd}}{{1,3}})\\)$', 1), '')) AS own FROM g)
SELECT page AS equation, CASE WHEN page % 3 = 0 THEN 'u' ELSE coalesce(raw, '') END AS unicode_text, coalesce(raw, '') AS raw_text, CASE WHEN page % 3 = 0 THEN 'x^2' END AS latex, coalesce(CASE WHEN page % 6 = 0 THEN '99' END, own) AS number FROM n""")
def equation_contents(spark, sf):
    members = _flow(spark, sf).where("part % 26 IN (5, 6, 20)").select("doc", F.col("page").alias("equation"), "pos", "text")
    e = F.col("equation")
    formulas = members.select("doc", "equation").distinct().where(e % 3 == 0).select("doc", "equation", F.lit("u").alias("unicode"), F.lit("").alias("raw"), F.lit("x^2").alias("latex"), F.lit(None).cast("string").alias("mathml"), F.when(e % 6 == 0, "99").alias("number"))
    return S.equation_content(members, formulas).select("equation", "unicode_text", "raw_text", "latex", "number")


_ROLES = f"""{_FLOW}, roles AS (SELECT *, CASE WHEN kind IN ('FIGURE', 'TABLE') THEN 'block' WHEN part % 26 IN (0, 2, 19, 24) THEN 'heading' WHEN kind = 'FORMULA' THEN 'equation' WHEN part % 3 = 0 THEN 'paragraph' END AS role FROM flow),
hd AS (SELECT *, last_value(CASE WHEN role = 'heading' THEN pos END IGNORE NULLS) OVER w AS head, last_value(CASE WHEN role = 'heading' THEN regexp_matches(s, '{R.BIBLIOGRAPHY}') END IGNORE NULLS) OVER w AS open FROM roles WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ls AS (SELECT *, max(CASE WHEN role = 'heading' AND regexp_matches(s, '{R.BIBLIOGRAPHY}') THEN pos END) OVER (PARTITION BY doc) AS last FROM hd), inb AS (SELECT * FROM ls WHERE open AND head = last AND (role IS NULL OR role = 'paragraph')),
entries AS (SELECT doc, pos, (sum(CASE WHEN regexp_matches(text, '{R.ENTRY_LABEL}') OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS entry FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS rn FROM inb))"""


def _roles(spark, sf):
    role = F.when(F.col("kind").isin("FIGURE", "TABLE"), "block").when((F.col("part") % 26).isin(0, 2, 19, 24), "heading").when(F.col("kind") == "FORMULA", "equation").when(F.col("part") % 3 == 0, "paragraph")
    return _flow(spark, sf).withColumn("role", role)


@query(f"WITH {_ROLES} SELECT * FROM entries")
def bibliography_fragments(spark, sf):
    return S.bibliography(_roles(spark, sf)).select("doc", "pos", "entry")


@query(f"""WITH {_FLOW}, {_HEAD.replace('FROM s)', 'FROM flow)', 1)} SELECT doc, f.pos, CASE WHEN f.part % 11 = 0 THEN 'caption' WHEN f.kind IN ('FIGURE', 'TABLE') THEN 'block' WHEN f.pos < 3 THEN 'front' WHEN f.part % 7 = 0 THEN 'equation' WHEN x.level IS NOT NULL THEN 'heading' WHEN f.part % 5 = 0 THEN 'entry' ELSE 'paragraph' END AS role
FROM flow f LEFT JOIN (SELECT region, level FROM heads) x USING (region)""")
def role_claims(spark, sf):
    flow = S.with_heading(_flow(spark, sf))
    where = lambda c: flow.where(c).select("doc", "pos")
    return S.claims(flow, where("pos < 3"), where("part % 11 = 0"), where("part % 7 = 0"), where("part % 5 = 0"))


_GROUPS = "mem AS (SELECT page AS grp, CASE WHEN page % 5 = 0 THEN 'OTHER' WHEN page % 2 = 0 THEN 'FIGURE_BLOCK' ELSE 'TABLE_BLOCK' END AS group_kind, region, kind FROM m_regions WHERE n > 4)"


@query(f"""WITH {_FLOW}, {_GROUPS}, b AS (SELECT group_kind, max(CASE WHEN kind = 'TEXT' THEN region END) AS caption, max(CASE WHEN kind IN ('FIGURE', 'TABLE') THEN region END) AS main FROM mem WHERE group_kind <> 'OTHER' GROUP BY grp, group_kind HAVING count(*) = 2 AND caption IS NOT NULL AND main IS NOT NULL)
SELECT caption + 1000 AS source, main + 1000 AS target FROM b WHERE caption % 13 <> 0 AND main % 13 <> 0""")
def caption_bindings(spark, sf):
    rows = M.df(spark, sf, "m_regions")
    page = F.col("page")
    members = rows.where("n > 4").select(page.alias("grp"), F.when(page % 5 == 0, "OTHER").when(page % 2 == 0, "FIGURE_BLOCK").otherwise("TABLE_BLOCK").alias("group_kind"), "region", "kind")
    return S.caption_relations(S.caption_bindings(members), rows.where("region % 13 <> 0").select("region", (F.col("region") + 1000).alias("node")))


@query()
def paragraph_groups(spark, sf):
    """Groups of two pages; the items of a page are the lines of its region, with gaps that differ."""
    rows = _flow(spark, sf).where("kind = 'TEXT'").select(F.expr("page div 2").alias("grp"), (F.col("page") * 10 + F.col("n")).alias("seq"), F.col("page").alias("region"), "text", (F.col("n") * 12 + F.col("part") % 4 * 9).cast("double").alias("y"), F.lit(10.0).alias("h"))
    return S.group_pieces(rows)


@query()
def inline_math(spark, sf):
    return S.inline_marks(M.df(spark, sf, "m_regions").select(F.col("region").alias("node"), "text"))


@query()
def node_marks(spark, sf):
    """Citations, notes and inline mathematics of paragraphs, in order."""
    notes, found = _notes(spark, sf)
    cited = S.resolved(*_cited(spark, sf)).where("target IS NOT NULL").select("node", "start", "stop", F.lit("CITATION").alias("type"), "target")
    linked = S.assign_notes(notes, found).where("node IS NOT NULL").select("node", "start", "stop", F.lit("FOOTNOTE_REFERENCE").alias("type"), F.col("note").alias("target"))
    inline = inline_math(spark, sf).select("node", "start", "stop", F.lit("INLINE_EQUATION").alias("type"), F.lit(None).cast("long").alias("target"))
    return S.marks(M.df(spark, sf, "m_nodes"), cited, linked, inline).select("node", F.to_json("marks").alias("marks"))


@query(f"""WITH {_FLOW}, t AS (SELECT region, [x FOR x IN [{_strip('text')}, ' ', {_strip("text || ' total'")}] IF {_strip('x')} <> ''] AS lines, part % 2 AS known, part % 7 AS n_cells FROM m_regions WHERE kind = 'TABLE')
SELECT region, CASE WHEN known = 1 AND n_cells > 0 THEN 4 WHEN part2 THEN 2 ELSE 1 END::BIGINT AS n_rows, CASE WHEN known = 1 AND n_cells > 0 THEN 3 ELSE 1 END::BIGINT AS n_columns, CASE WHEN known = 1 AND n_cells > 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN known = 1 AND n_cells > 0 THEN 'table structure evidence' ELSE 'table fallback: line rows' END AS reason
FROM (SELECT *, region % 3 <> 0 AS part2 FROM t)""")
def table_contents(spark, sf):
    rows = M.df(spark, sf, "m_regions").where("kind = 'TABLE'")
    # Lines of every third table are missing: its text is taken.
    lines = F.when(F.col("region") % 3 != 0, F.array("text", F.lit(" "), F.concat("text", F.lit(" total"))))
    cells = rows.where("part % 2 = 1").select("region", F.lit(4).alias("n_rows"), F.lit(3).alias("n_columns"), (F.col("part") % 7).alias("n_cells"))
    return S.table_content(rows.select("region", "text", lines.alias("lines")), cells)


_CLAIMED = """claimed AS (SELECT doc, pos, kind, CASE WHEN kind IN ('FIGURE', 'TABLE') THEN 'block' ELSE (['front', 'heading', 'equation', 'caption', 'entry', 'note', 'paragraph'])[(part % 7 + 1)::INT] END AS role, CASE WHEN part % 2 = 0 THEN 'TABLE_BLOCK' ELSE 'FIGURE_BLOCK' END AS group_kind,
  CASE WHEN part % 4 = 0 THEN '1.2' END AS numbering, 1 + part % 3 AS n_members, CASE WHEN part % 5 > 0 THEN 0.6 + part % 5 / 20.0 END::DOUBLE AS continuation, part % 3 = 0 AS has_label, (['title', 'author', 'abstract-title'])[(part % 3 + 1)::INT] AS front_role, part % 5 = 0 AS has_cells FROM flow)"""


def _claimed(spark, sf):
    p = F.col("part")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (p % n + 1).cast("int"))
    return _flow(spark, sf).select(
        "doc", "pos", "kind", F.when(F.col("kind").isin("FIGURE", "TABLE"), "block").otherwise(pick(["front", "heading", "equation", "caption", "entry", "note", "paragraph"], 7)).alias("role"), F.when(p % 2 == 0, "TABLE_BLOCK").otherwise("FIGURE_BLOCK").alias("group_kind"),
        F.when(p % 4 == 0, "1.2").alias("numbering"), (1 + p % 3).alias("n_members"), F.when(p % 5 > 0, F.lit(0.6) + p % 5 / 20).alias("continuation"), (p % 3 == 0).alias("has_label"), pick(["title", "author", "abstract-title"], 3).alias("front_role"), (p % 5 == 0).alias("has_cells"),
    )


@query(f"""WITH {_FLOW}, {_CLAIMED} SELECT doc, pos,
CASE role WHEN 'front' THEN CASE WHEN front_role IN ('title', 'abstract-title') THEN 'HEADING' ELSE 'PARAGRAPH' END WHEN 'heading' THEN 'HEADING' WHEN 'equation' THEN 'EQUATION' WHEN 'block' THEN kind WHEN 'caption' THEN CASE group_kind WHEN 'TABLE_BLOCK' THEN 'TABLE_CAPTION' ELSE 'FIGURE_CAPTION' END WHEN 'entry' THEN 'BIBLIOGRAPHY_ENTRY' WHEN 'note' THEN 'FOOTNOTE' ELSE 'PARAGRAPH' END AS node_kind,
round(CASE role WHEN 'front' THEN CASE WHEN front_role IN ('title', 'abstract-title') THEN 0.6 ELSE 0.8 END WHEN 'heading' THEN 0.6 WHEN 'equation' THEN 0.55 WHEN 'block' THEN CASE WHEN kind = 'TABLE' THEN CASE WHEN has_cells THEN 0.8 ELSE 0.6 END ELSE 0.7 END WHEN 'caption' THEN 0.7 WHEN 'entry' THEN CASE WHEN has_label THEN 0.75 ELSE 0.8 END WHEN 'note' THEN 0.7
  ELSE CASE WHEN n_members > 1 THEN least(0.75, coalesce(continuation, 0.5)) ELSE 0.8 END END, 6)::DOUBLE AS confidence,
CASE role WHEN 'front' THEN 'front matter ' || front_role WHEN 'heading' THEN CASE WHEN numbering IS NOT NULL THEN 'numbered section heading' ELSE 'layout heading label' END WHEN 'equation' THEN 'display equation: ' || n_members || ' regions' WHEN 'block' THEN CASE WHEN kind = 'TABLE' THEN CASE WHEN has_cells THEN 'table structure evidence' ELSE 'table fallback: line rows' END ELSE 'layout figure region' END
  WHEN 'caption' THEN 'layout caption group' WHEN 'entry' THEN CASE WHEN has_label THEN 'bibliography entry' ELSE 'bibliography fragment' END WHEN 'note' THEN 'layout footnote region' ELSE CASE WHEN n_members > 1 THEN 'paragraph merge: ' || n_members || ' regions' ELSE 'layout text region' END END AS reason FROM claimed""")
def node_emitters(spark, sf):
    return S.emitted(_claimed(spark, sf)).select("doc", "pos", "node_kind", F.round("confidence", 6).alias("confidence"), "reason")


@query(f"""WITH {M.ctes('m_nodes')}, nr AS (SELECT node, 0 AS pos, region FROM m_nodes WHERE region IS NOT NULL UNION ALL SELECT node, 1, region + 1 FROM m_nodes WHERE region % 2 = 0), rec AS (SELECT region, 'r' || region || x AS record FROM m_nodes, (VALUES ('a'), ('b')) v(x) WHERE region > 0 AND region % 3 = 0),
rr AS (SELECT region, string_agg(record, ',' ORDER BY record) AS r FROM rec GROUP BY region), refs AS (SELECT node, string_agg(nr.region || CASE WHEN r IS NULL THEN '' ELSE ',' || r END, ',' ORDER BY pos) AS input_refs FROM nr LEFT JOIN rr USING (region) GROUP BY node)
SELECT node, coalesce(input_refs, 'layout ' || doc) AS input_refs, substr(sha256(concat_ws(chr(31), doc, 'sem-prov', 'node', node)), 1, 32) AS record FROM m_nodes LEFT JOIN refs USING (node)""")
def node_provenance(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    bound = nodes.where("region IS NOT NULL").select("node", F.lit(0).alias("pos"), "region").union(nodes.where("region % 2 = 0").select("node", F.lit(1), F.col("region") + 1))
    records = nodes.where("region > 0 AND region % 3 = 0").select("region", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x")).select("region", F.concat(F.lit("r"), F.col("region").cast("string"), "x").alias("record"))
    return S.provenance(nodes.withColumn("operation", F.lower("kind")), bound, records).select("node", "input_refs", "record")


_SEC = f"regexp_matches(s, '{R.SECTION_HEAD}')"


@query(f"""WITH {_FLOW}, b AS (SELECT *, row_number() OVER w AS rn, lead(s, 1) OVER w AS t1, lead(s, 2) OVER w AS t2, lead(s, 3) OVER w AS t3, coalesce(lead({_SEC}, 1) OVER w, true) AS s1, coalesce(lead({_SEC}, 2) OVER w, true) AS s2, coalesce(lead({_SEC}, 3) OVER w, true) AS s3 FROM flow WHERE page_index = 0 WINDOW w AS (PARTITION BY doc ORDER BY pos)),
a AS (SELECT *, left(concat_ws(' ', nullif({_strip("regexp_replace(s, '^\\S+', '')")}, ''), CASE WHEN NOT s1 THEN nullif(t1, '') END, CASE WHEN NOT s1 AND NOT s2 THEN nullif(t2, '') END, CASE WHEN NOT s1 AND NOT s2 AND NOT s3 THEN nullif(t3, '') END), 600) AS abs,
  rn BETWEEN 2 AND 4 AND length(s) BETWEEN 1 AND 120 AND NOT regexp_matches(s, '{R.ABSTRACT_HEAD}') AND NOT {_SEC} AND font <= 11.5 AND (contains(s, ',') OR contains(s, ' and ') OR regexp_matches(s, '{R.AUTHOR_MARK.replace("'", "''")}')) AS line FROM b),
g AS (SELECT doc, arg_min(s, rn) AS title, arg_min(s, rn) FILTER (line) AS author, arg_min(abs, rn) FILTER (regexp_matches(s, '{R.ABSTRACT_HEAD}')) AS abstract FROM a GROUP BY doc)
SELECT doc, 'title' AS name, title AS value FROM g UNION ALL SELECT doc, 'author', author FROM g WHERE author <> '' UNION ALL SELECT doc, 'abstract', abstract FROM g WHERE abstract <> ''""")
def scholarly_metadata(spark, sf):
    return S.scholarly(_flow(spark, sf).withColumn("body_font", F.lit(10.0)))


_TREE = f"""{_FLOW}, {_HEAD.replace('FROM s)', 'FROM flow)', 1)}"""


@query(f"""WITH {_TREE}, hs AS (SELECT doc, pos, level FROM heads) SELECT f.doc, f.pos, CASE WHEN x.level IS NULL THEN (SELECT max(y.pos) FROM hs y WHERE y.doc = f.doc AND y.pos < f.pos) ELSE (SELECT max(y.pos) FROM hs y WHERE y.doc = f.doc AND y.pos < f.pos AND y.level < x.level) END AS section FROM flow f LEFT JOIN hs x ON x.doc = f.doc AND x.pos = f.pos""")
def section_tree(spark, sf):
    return T.sections(S.with_heading(_flow(spark, sf)), ["doc"], "pos").select("doc", "pos", "section")


@query(f"WITH {M.ctes('m_nodes')} SELECT doc, parent, string_agg(node, ',' ORDER BY pos, node) AS children FROM m_nodes WHERE parent IS NOT NULL GROUP BY doc, parent")
def child_lists(spark, sf):
    return T.children(M.df(spark, sf, "m_nodes"), ["doc"]).select("doc", "parent", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


# Chains of up to twelve nodes; every fifth chain closes on itself.
_RINGS = "rings AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 12 > 0 THEN o_orderkey - 1 WHEN o_orderkey // 12 % 5 = 0 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey + 7) THEN o_orderkey + 7 END AS parent FROM orders o)"


def _rings(spark, sf):
    orders = M.df(spark, sf, "orders").select(F.col("o_orderkey").alias("node"))
    there = orders.select((F.col("node") - 7).alias("node"), F.lit(True).alias("there"))
    parent = F.when(F.col("node") % 12 > 0, F.col("node") - 1).when((F.expr("node div 12") % 5 == 0) & F.col("there"), F.col("node") + 7)
    return orders.join(there, "node", "left").select("node", parent.alias("parent"), F.lit(0).cast("long").alias("pos"))


@query(f"WITH {_RINGS} SELECT node FROM rings r WHERE node // 12 % 5 = 0 AND node % 12 <= 7 AND EXISTS (SELECT 1 FROM rings t WHERE t.node = r.node - r.node % 12 AND t.parent IS NOT NULL)")
def tree_cycles(spark, sf):
    return T.cycles(_rings(spark, sf))


@query(f"WITH {M.ctes('m_nodes')}, l AS (SELECT n.node, coalesce(p.kind = 'BIBLIOGRAPHY', false) OR coalesce(g.kind = 'BIBLIOGRAPHY', false) OR coalesce(e.kind = 'BIBLIOGRAPHY', false) AS below FROM m_nodes n LEFT JOIN m_nodes p ON p.node = n.parent LEFT JOIN m_nodes g ON g.node = p.parent LEFT JOIN m_nodes e ON e.node = g.parent) SELECT node, below FROM l")
def below_bibliography(spark, sf):
    return T.below(M.df(spark, sf, "m_nodes"), F.col("kind") == "BIBLIOGRAPHY")


@query(f"""WITH {M.ctes('m_nodes')}, w AS (SELECT n.doc, n.node, coalesce(p.pos, n.pos - 1) * 1000 + n.pos AS ord, n.kind, n.text, p.kind AS pk FROM m_nodes n LEFT JOIN m_nodes p ON p.node = n.parent)
SELECT doc, arg_min(text, {{'o': ord, 'n': node}}) AS title FROM w WHERE text <> '' AND (kind IN ('FRONT_MATTER', 'HEADING') OR (kind = 'PARAGRAPH' AND pk = 'SECTION' AND ord < 1000)) GROUP BY doc""")
def document_title(spark, sf):
    """The first heading in tree order, or paragraph of the first section, which stands for front matter."""
    nodes = M.df(spark, sf, "m_nodes")
    up = nodes.select(F.col("node").alias("parent"), F.col("kind").alias("pk"), F.col("pos").alias("pp"))
    rows = nodes.join(up, "parent", "left").withColumn("ord", F.coalesce("pp", F.col("pos") - 1) * 1000 + F.col("pos"))
    may = (F.col("text") != "") & (F.col("kind").isin("FRONT_MATTER", "HEADING") | (F.col("kind") == "PARAGRAPH") & (F.col("pk") == "SECTION") & (F.col("ord") < 1000))
    return rows.where(may).groupBy("doc").agg(F.min_by("text", F.struct("ord", "node")).alias("title"))


@query(f"""WITH {M.ctes('m_regions')}, c AS (SELECT doc, region, part, page_index * 10 + n AS pos FROM m_regions WHERE part % 4 = 0), f AS (SELECT c.*, x.k, x.name, x.value FROM c, LATERAL (VALUES (0, 'title', 'T' || part), (1, 'author', 'A'), (2, 'title', 'U' || region)) x(k, name, value)), m AS (SELECT doc, min(pos) AS pos FROM c GROUP BY doc)
SELECT f.doc, name, arg_max(value, k) AS value FROM f JOIN m USING (doc, pos) GROUP BY f.doc, name""")
def first_metadata(spark, sf):
    """The fields of a document's first metadata candidate; of a name given twice the last value."""
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = F.array(field("title", F.concat(F.lit("T"), F.col("part").cast("string"))), field("author", F.lit("A")), field("title", F.concat(F.lit("U"), F.col("region").cast("string"))))
    rows = _flow(spark, sf).where("part % 4 = 0").select("doc", "pos", fields.alias("fields"))
    first = rows.groupBy("doc").agg(F.min_by("fields", "pos").alias("fields")).select("doc", F.posexplode("fields").alias("k", "f"))
    return first.groupBy("doc", "f.name").agg(F.max_by("f.value", "k").alias("value")).select("doc", "name", "value")


@query(f"WITH {M.ctes('m_nodes', 'm_regions')}, nr AS (SELECT node, region FROM m_nodes WHERE kind = 'PARAGRAPH' AND region IS NOT NULL UNION ALL SELECT node, region + 10 FROM m_nodes WHERE kind = 'PARAGRAPH') SELECT node, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM nr JOIN m_regions r USING (region) GROUP BY node")
def paragraph_pages(spark, sf):
    nodes = M.df(spark, sf, "m_nodes").where("kind = 'PARAGRAPH'")
    bound = nodes.where("region IS NOT NULL").select("node", "region").union(nodes.where("region IS NOT NULL").select("node", F.col("region") + 10))
    rows = bound.join(M.df(spark, sf, "m_regions").select("region", "page"), "region").groupBy("node").agg(F.sort_array(F.collect_set("page")).alias("p"))
    return rows.select("node", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"))


@query(f"WITH {M.ctes('m_regions')} SELECT page, coalesce(max(font) FILTER (kind = 'TEXT'), 0)::DOUBLE AS title_font, coalesce(max(font) FILTER (kind = 'TEXT'), 'inf'::DOUBLE) AS other_font FROM m_regions GROUP BY page")
def largest_fonts(spark, sf):
    own = F.max(F.when(F.col("kind") == "TEXT", F.col("font")))
    return M.df(spark, sf, "m_regions").groupBy("page").agg(F.coalesce(own, F.lit(0.0)).alias("title_font"), F.coalesce(own, F.lit(float("inf"))).alias("other_font"))


@query(f"""WITH {M.ctes('m_regions')}, b AS (SELECT page, 0 AS band, 0 AS y0, 120 AS y1 UNION ALL SELECT page, 1, 120, 400 FROM (SELECT DISTINCT page FROM m_regions) UNION ALL SELECT page, 0, 0, 120 FROM m_regions WHERE false), bb AS (SELECT DISTINCT page, band, y0, y1 FROM (SELECT page, 0 AS band, 0::DOUBLE AS y0, 120::DOUBLE AS y1 FROM m_regions UNION ALL SELECT page, 1, 120, 400 FROM m_regions)),
c AS (SELECT page, band, k AS col, k * 200::DOUBLE AS cx, 200::DOUBLE AS cw, y0, y1 FROM bb, range(2) r(k)), s AS (SELECT r.page, r.region, r.x, r.w, r.y, r.h, c.band, c.col, greatest(least(r.x + r.w, cx + cw) - greatest(r.x, cx), 0) * greatest(least(r.y + r.h, y1) - greatest(r.y, y0), 0) / (cw * (y1 - y0)) AS inside, greatest(least(r.y + r.h, y1) - greatest(r.y, y0), 0) AS overlap FROM m_regions r JOIN c USING (page)),
best AS (SELECT region, band, col, inside FROM s QUALIFY row_number() OVER (PARTITION BY region ORDER BY inside DESC, band, col) = 1), fb AS (SELECT region, band, CASE WHEN x + w / 2 < 280 THEN 0 ELSE 1 END AS col FROM s QUALIFY row_number() OVER (PARTITION BY region ORDER BY overlap DESC, band, col) = 1)
SELECT region, CASE WHEN inside > 0 THEN b2.band ELSE fb.band END::BIGINT AS band, CASE WHEN inside > 0 THEN b2.col ELSE fb.col END::BIGINT AS col FROM best b2 JOIN fb USING (region)""".replace("b AS (SELECT page, 0 AS band, 0 AS y0, 120 AS y1 UNION ALL SELECT page, 1, 120, 400 FROM (SELECT DISTINCT page FROM m_regions) UNION ALL SELECT page, 0, 0, 120 FROM m_regions WHERE false), ", ""))
def orphan_columns(spark, sf):
    """Regions without a column: that of which they hold the greatest share, else the outer one of the band they overlap most, by the half of the page."""
    regions = M.df(spark, sf, "m_regions")
    band = lambda n, top, bottom: F.struct(F.lit(n).alias("band"), F.lit(top).alias("y0"), F.lit(bottom).alias("y1"))
    two = regions.select("page").distinct().select("page", F.explode(F.array(band(0, 0.0, 120.0), band(1, 120.0, 400.0))).alias("b")).select("page", "b.*")
    cols = two.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("col")).select("page", "band", "y0", "y1", "col", (F.col("col") * 200.0).alias("cx"), F.lit(200.0).alias("cw"))
    return P.placed_orphans(regions, cols, 560.0)
