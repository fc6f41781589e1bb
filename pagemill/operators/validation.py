"""Constraint queries over the layers of documents: each gives rows of rule and subject (and severity, where rules differ in it).

Every rule is an anti-join or a join on one key, so the whole is a union of independent shuffles that Spark plans together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds that need source regions, and the kinds that targets of marks and relations may have.
BOUND_KINDS = ("PARAGRAPH", "HEADING", "FIGURE", "FIGURE_CAPTION", "TABLE", "TABLE_CAPTION", "EQUATION", "FOOTNOTE", "BIBLIOGRAPHY_ENTRY")
MARK_TARGETS = {"CITATION": ("BIBLIOGRAPHY_ENTRY",), "FOOTNOTE_REFERENCE": ("FOOTNOTE",)}
RELATION_TARGETS = {"CAPTION_OF": ("FIGURE", "TABLE"), "CITES": ("BIBLIOGRAPHY_ENTRY",), "FOOTNOTE_OF": ("PARAGRAPH", "UNKNOWN")}
# Keys that one layer may not hold of the other.
GEOMETRY_KEYS = ("page", "bbox", "column", "pagebreak", "pagesize", "font", "fontsize")
SEMANTIC_KEYS = ("section", "heading_level", "citation", "bibliography", "translation", "method_section", "paragraph")
SEMANTIC_LABELS = ("SECTION", "CITATION", "BIBLIOGRAPHY")


def found(rows: DataFrame, rule: str, *subject: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws(" ", *[F.col(c).cast("string") for c in subject]).alias("subject"))


def all_of(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def unknown(rows: DataFrame, ref: str, known: DataFrame, key: str, rule: str, *subject: str) -> DataFrame:
    """Rows whose reference is set and not among the known keys."""
    keys = known.select(F.col(key).alias("_k")).distinct()
    return found(rows.where(F.col(ref).isNotNull()).join(keys, F.col(ref) == F.col("_k"), "left_anti"), rule, *subject)


def mismatch(rows: DataFrame, ref: str, own: str, known: DataFrame, key: str, theirs: str, rule: str, *subject: str) -> DataFrame:
    """Rows whose reference is known, and has another value in `theirs` than the row in `own`."""
    targets = known.select(F.col(key).alias("_k"), F.col(theirs).alias("_t"))
    return found(rows.join(targets, F.col(ref) == F.col("_k")).where(~F.col("_t").eqNullSafe(F.col(own))), rule, *subject)


def unlisted(rows: DataFrame, keys: list[str], listing: DataFrame, rule: str, *subject: str) -> DataFrame:
    """Rows that are in no list of their holder."""
    return found(rows.join(listing.select(*keys).distinct(), keys, "left_anti"), rule, *subject)


def physical(pages: DataFrame, objects: DataFrame, listing: DataFrame) -> DataFrame:
    """pages: page; objects: object, page; listing: page, object as pages list them."""
    placed = objects.join(pages.select("page").distinct(), "page", "left_semi")
    return all_of([
        unknown(listing, "object", objects, "object", "page lists unknown object", "page", "object"),
        mismatch(listing, "object", "page", objects, "object", "page", "listed object belongs to another page", "page", "object"),
        unknown(objects, "page", pages, "page", "object on unknown page", "object"),
        unlisted(placed, ["page", "object"], listing, "object not listed by its page", "object"),
    ])


def layout(pages: DataFrame, regions: DataFrame, bands: DataFrame, columns: DataFrame, page_regions: DataFrame, page_bands: DataFrame, band_columns: DataFrame, column_regions: DataFrame) -> DataFrame:
    """Pages, regions, bands and columns, and the lists that each holds of the next; all have the page they are on."""
    on_page = lambda rows: rows.join(pages.select("page").distinct(), "page", "left_semi")
    placed = column_regions.join(columns.select("col", "page"), "col")
    return all_of([
        unknown(page_regions, "region", regions, "region", "page lists unknown region", "page", "region"),
        mismatch(page_regions, "region", "page", regions, "region", "page", "listed region belongs to another page", "page", "region"),
        unknown(page_bands, "band", bands, "band", "page lists unknown band", "page", "band"),
        mismatch(page_bands, "band", "page", bands, "band", "page", "listed band belongs to another page", "page", "band"),
        unknown(regions, "page", pages, "page", "region on unknown page", "region"),
        unlisted(on_page(regions), ["page", "region"], page_regions, "region not listed by its page", "region"),
        unknown(bands, "page", pages, "page", "band on unknown page", "band"),
        unlisted(on_page(bands), ["page", "band"], page_bands, "band not listed by its page", "band"),
        unknown(band_columns, "col", columns, "col", "band lists unknown column", "band", "col"),
        unknown(columns, "page", pages, "page", "column on unknown page", "col"),
        unknown(columns, "band", bands, "band", "column of unknown band", "col"),
        mismatch(columns, "band", "page", bands, "band", "page", "band of column belongs to another page", "col"),
        unknown(placed, "region", regions, "region", "column lists unknown region", "col", "region"),
        mismatch(placed, "region", "page", regions, "region", "page", "region of column belongs to another page", "col", "region"),
    ])


def groups(members: DataFrame, regions: DataFrame) -> DataFrame:
    """members: grp, page (null if the group has none), region."""
    return all_of([
        unknown(members, "region", regions, "region", "group has unknown member", "grp", "region"),
        mismatch(members.where("page IS NOT NULL"), "region", "page", regions, "region", "page", "member belongs to another page", "grp", "region"),
    ])


def flow(regions: DataFrame, nodes: DataFrame, edges: DataFrame, primary: DataFrame) -> DataFrame:
    """nodes and primary: region; edges: source, target."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("region")), F.struct(F.lit("target").alias("side"), F.col("target").alias("region")))).alias("e")).select("e.*")
    known = regions.select("region").distinct()
    outside = lambda rows: rows.join(known, "region", "left_semi").join(nodes.select("region").distinct(), "region", "left_anti")
    return all_of([
        unknown(nodes, "region", regions, "region", "flow has unknown node", "region"),
        unknown(ends, "region", regions, "region", "edge has unknown end", "side", "region"),
        found(outside(ends), "end of edge is no node of the flow", "side", "region"),
        unknown(primary, "region", regions, "region", "primary flow has unknown region", "region"),
        found(outside(primary), "region of primary flow is no node of the flow", "region"),
    ])


def evidence(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates: candidate, page and parent, either of which may be null."""
    return all_of([unknown(candidates, "page", pages, "page", "candidate on unknown page", "candidate"), unknown(candidates, "parent", candidates, "candidate", "candidate of unknown parent", "candidate")])


def tree(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """nodes: node, parent; children: parent, child as parents list them, repeats included."""
    listed = children.groupBy("child").agg(F.countDistinct("parent").alias("n"))
    again = children.groupBy("parent", "child").agg(F.count("*").alias("n")).where("n > 1")
    own = nodes.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent")
    return all_of([
        unknown(nodes, "parent", nodes, "node", "unknown parent", "node"),
        unknown(children, "child", nodes, "node", "unknown child", "parent", "child"),
        mismatch(children, "child", "parent", nodes, "node", "parent", "child names another parent", "parent", "child"),
        unlisted(own, ["parent", "child"], children, "not listed by its parent", "child"),
        found(again, "child listed more than once", "parent", "child"),
        found(listed.where("n > 1"), "child of several parents", "child"),
    ])


def targets(rows: DataFrame, nodes: DataFrame, allowed: dict[str, tuple[str, ...]], *subject: str) -> DataFrame:
    """rows: type and target, of marks or relations; nodes: node, kind. Types that are not in allowed may go anywhere."""
    fits = reduce(Column.__or__, [(F.col("type") == t) & F.col("_kind").isin(*kinds) for t, kinds in allowed.items()])
    known = nodes.select(F.col("node").alias("_n"), F.col("kind").alias("_kind"))
    judged = rows.where(F.col("type").isin(*allowed) & F.col("target").isNotNull()).join(known, F.col("target") == F.col("_n"), "left")
    category = F.when(F.col("type").isin("CITATION", "CITES"), "CITATION_RESOLUTION").otherwise("SOURCE_MAPPING")
    return found(judged.where(~F.coalesce(fits, F.lit(False))).withColumn("category", category), "target of unexpected kind", "category", "type", *subject)


def ends(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations: source, target, type."""
    return all_of([unknown(relations, "source", nodes, "node", "relation from unknown node", "type", "source"), unknown(relations, "target", nodes, "node", "relation to unknown node", "type", "target")])


def bindings(nodes: DataFrame, node_regions: DataFrame, regions: DataFrame) -> DataFrame:
    """nodes: node, kind; node_regions: node, region. Kinds with sources need at least one, and all must be known."""
    bound = nodes.where(F.col("kind").isin(*BOUND_KINDS)).select("node", "kind")
    return all_of([
        found(bound.join(node_regions.select("node").distinct(), "node", "left_anti"), "no source regions", "kind", "node"),
        unknown(node_regions.join(bound, "node"), "region", regions, "region", "unknown source region", "node", "region"),
    ])


def captions(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Captions that caption nothing, with the category of what they should."""
    category = F.when(F.col("kind") == "TABLE_CAPTION", "TABLE_RECOVERY").otherwise("FIGURE_RECOVERY")
    linked = relations.where("type = 'CAPTION_OF'").select(F.col("source").alias("node")).distinct()
    return found(nodes.where("kind IN ('FIGURE_CAPTION', 'TABLE_CAPTION')").join(linked, "node", "left_anti").withColumn("category", category), "caption of nothing", "category", "node")


def chain(documents: DataFrame) -> DataFrame:
    """Documents whose layers name others than the one below: physical, layout_of; layout, semantic_of; semantic, translation_of, render_of; translation, rendered_translation."""
    differ = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    strict = lambda a, b: F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    return all_of([
        found(documents.where(strict("physical", "layout_of")), "layout of another physical document", "doc"),
        found(documents.where(differ("layout", "semantic_of")), "semantics of another layout", "doc"),
        found(documents.where("translated").where(strict("semantic", "translation_of")), "translation of other semantics", "doc"),
        found(documents.where("rendered").where(strict("semantic", "render_of")), "rendering of other semantics", "doc"),
        found(documents.where("rendered AND translated").where(differ("translation", "rendered_translation")), "rendering of another translation", "doc"),
    ])


def json_keys(json: Column) -> Column:
    """All keys of a JSON text, at every depth."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(r'"([A-Za-z_]+)"\s*:'), F.lit(1)))


def layers_apart(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """regions: region, json and labels (array); nodes: node, attributes (JSON). Neither layer may hold keys of the other."""
    key = lambda rows, c: rows.select("*", F.explode(json_keys(F.col(c))).alias("key"))
    geometry = F.lower("key").isin(*GEOMETRY_KEYS) | F.col("key").rlike(r"(?i)[^a-z]bbox|\bbbox\b")
    return all_of([
        found(key(regions, "json").where(F.lower("key").isin(*SEMANTIC_KEYS)), "semantic key in layout", "region", "key"),
        found(regions.select("region", F.explode("labels").alias("label")).where(F.col("label").isin(*SEMANTIC_LABELS)), "semantic label in layout", "region", "label"),
        found(key(nodes, "attributes").where(geometry), "geometry key in semantics", "node", "key"),
    ])


def policy_issues(blocks: DataFrame) -> DataFrame:
    """blocks: node, kind, n_resources, has_caption, caption_position, long_equation. One row for each rule that a block meets, with its fallback."""
    rule = lambda when, token, fallback: F.when(when, F.struct(F.lit(token).alias("rule"), F.lit(fallback).alias("fallback")))
    source = F.col("has_caption") & (F.col("caption_position") == "SOURCE")
    rules = F.array(
        rule((F.col("kind") == "FIGURE") & (F.col("n_resources") > 1), "multi-figure-layout", "stacked includegraphics"),
        rule((F.col("kind") == "FIGURE") & source, "caption-source-figure", "BELOW"),
        rule((F.col("kind") == "TABLE") & source, "caption-source-table", "ABOVE"),
        rule((F.col("kind") == "EQUATION") & (F.col("long_equation") == "MULTILINE"), "equation-multiline", "SCALE_DOWN"),
    )
    return blocks.select("node", F.explode(F.array_compact(rules)).alias("r")).select("node", "r.*")


def once(issues: DataFrame) -> DataFrame:
    """One issue for each category and message: the first by seq, with the id of its content."""
    w = Window.partitionBy("doc", "category", "message").orderBy("seq")
    key = F.concat_ws("\x1f", F.col("doc").cast("string"), F.lit("issue"), "category", "message")
    return issues.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("issue_id", F.substring(F.sha2(key, 256), 1, 32))
