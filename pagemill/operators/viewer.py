"""What the reader shows: pairs of source and rendering, hits, issues, provenance and text of nodes, and the bundle of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells of the grid that fragments of a page are found by, and the version of bundles.
GRID = (8, 12)
BUNDLE_VERSION = 2
TEXT_KINDS = ("TEXT", "FOOTNOTE", "TABLE", "FORMULA")
CITATION_MARKS = ("CITATION", "FIGURE_REFERENCE", "TABLE_REFERENCE", "EQUATION_REFERENCE", "SECTION_REFERENCE", "FOOTNOTE_REFERENCE")
ARRAYS = ("sourceSemanticBindings", "sourceAnchors", "sourceRegions", "renderAnchors", "semanticRelations", "provenance", "issues", "semanticNodes")


def stable(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def region_lines(regions: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """regions: region, kind; members: region, pos, item; spans: item, text, x, y, w, h, font. The lines of regions that hold text, in order; a missing size is the height."""
    line = F.struct("pos", "text", "x", "y", "w", "h", F.when(F.col("font") > 0, F.col("font")).otherwise(F.col("h")).alias("font"))
    rows = regions.where(F.col("kind").isin(*TEXT_KINDS)).select("region").join(members, "region").join(spans, "item")
    return rows.groupBy("region").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def source_anchors(nodes: DataFrame, node_regions: DataFrame) -> DataFrame:
    """nodes: doc, node, parent; node_regions: node, pos, region. An anchor for each node with regions but the root."""
    refs = node_regions.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "region"))), lambda s: s["region"]).alias("regions"))
    return nodes.where("parent IS NOT NULL").join(refs, "node").select("doc", "node", stable(F.col("doc"), F.lit("source-anchor"), F.col("node")).alias("anchor"), "regions", F.lit(0.7).alias("confidence"))


def figure_images(figures: DataFrame, region_objects: DataFrame, images: DataFrame) -> DataFrame:
    """figures: node, pos, region; region_objects: region, n, object; images: object. The embedded images of each figure, each once, as first met."""
    rows = figures.join(region_objects, "region").join(images.select("object").distinct(), "object")
    first = rows.groupBy("node", "object").agg(F.min(F.struct("pos", "n")).alias("k"))
    return first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "object"))), lambda s: s["object"]).alias("images"))


def shown_resources(images: Column, fragment: Column, available: Column) -> Column:
    """A figure's usable fragment alone, else its usable images."""
    return F.when(fragment.isNotNull() & F.array_contains(available, fragment), F.array(fragment)).otherwise(F.filter(images, lambda i: F.array_contains(available, i)))


def pairs(bindings: DataFrame, anchors: DataFrame, regions: DataFrame, rendered: DataFrame) -> DataFrame:
    """node, side, page, x, y, w, h, n of nodes with fragments on both sides.

    bindings: node, b, a, anchor; anchors: anchor, f, region; regions: region, page, x, y, w, h; rendered: node, r, f, page, x, y, w, h.
    Of rendered anchors of one node the last counts; so does the last binding.
    """
    last = bindings.groupBy("node").agg(F.max("b").alias("b"))
    source = bindings.join(last, ["node", "b"]).join(anchors, "anchor").join(regions, "region")
    source = source.select("node", F.lit("source").alias("side"), "page", "x", "y", "w", "h", F.row_number().over(Window.partitionBy("node").orderBy("a", "f")).alias("n"))
    newest = rendered.groupBy("node").agg(F.max("r").alias("r"))
    target = rendered.join(newest, ["node", "r"]).select("node", F.lit("target").alias("side"), "page", "x", "y", "w", "h", F.row_number().over(Window.partitionBy("node").orderBy("f")).alias("n"))
    both = source.select("node").distinct().join(target.select("node").distinct(), "node")
    return source.union(target).join(both, "node", "left_semi")


def counterpart(origins: DataFrame, fragments: DataFrame) -> DataFrame:
    """origins: origin, node, page, y; fragments: node, page, y, n. On the smallest page from the origin's on (else the smallest), the nearest by height, of equals the first."""
    rows = origins.join(fragments.select("node", F.col("page").alias("fp"), F.col("y").alias("fy"), "n"), "node")
    key = F.struct(F.when(F.col("fp") >= F.col("page"), 0).otherwise(1), "fp", F.abs(F.col("fy") - F.col("y")), "n")
    return rows.groupBy("origin", "node").agg(F.min_by(F.struct(F.col("fp").alias("page"), "n"), key).alias("f")).select("origin", "node", "f.page", "f.n")


def _cell(value: Column, size: float, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(value / (size / n)))).cast("int")


def indexed(fragments: DataFrame, width: float, height: float) -> DataFrame:
    """fragments (with an area) once for each grid cell they touch."""
    cols = F.sequence(_cell(F.col("x"), width, GRID[0]), _cell(F.col("x") + F.col("w"), width, GRID[0]))
    rows = F.sequence(_cell(F.col("y"), height, GRID[1]), _cell(F.col("y") + F.col("h"), height, GRID[1]))
    return fragments.where("w > 0 AND h > 0").withColumn("cell_x", F.explode(cols)).withColumn("cell_y", F.explode(rows))


def hits(points: DataFrame, fragments: DataFrame, width: float, height: float) -> DataFrame:
    """points: point, page, px, py; fragments: fragment, page, x, y, w, h. All that hold the point, the smallest first (position); found by page and cell."""
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height)
    at = points.where(inside).withColumn("cell_x", F.floor(F.col("px") / (width / GRID[0])).cast("int")).withColumn("cell_y", F.floor(F.col("py") / (height / GRID[1])).cast("int"))
    met = at.join(indexed(fragments, width, height), ["page", "cell_x", "cell_y"]).where("px >= x AND px <= x + w AND py >= y AND py <= y + h")
    area = F.round(F.col("w") * F.col("h"), 6)
    return met.select("point", "fragment", F.row_number().over(Window.partitionBy("point").orderBy(area, "fragment")).cast("long").alias("position"))


def in_bands(bands: DataFrame, fragments: DataFrame, width: float, height: float) -> DataFrame:
    """bands: band, page, y_min, y_max. The fragments that a band crosses, from the top; found by page and row of cells."""
    rows = F.sequence(_cell(F.col("y_min"), height, GRID[1]), _cell(F.col("y_max"), height, GRID[1]))
    at = bands.where("y_max >= y_min").withColumn("cell_y", F.explode(rows))
    held = indexed(fragments, width, height).select("page", "cell_y", "fragment", "y", "h").distinct()
    met = at.join(held, ["page", "cell_y"]).where("y <= y_max AND y + h >= y_min").select("band", "fragment", "y").distinct()
    return met.select("band", "fragment", F.row_number().over(Window.partitionBy("band").orderBy("y", "fragment")).cast("long").alias("position"))


def to_page(x: Column, y: Column, left: Column, top: Column, shown_width: Column, shown_height: Column, width: Column, height: Column) -> Column:
    """Screen pixels as points of the page; null without an area."""
    return F.when((shown_width > 0) & (shown_height > 0), F.struct(((x - left) / shown_width * width).alias("px"), ((y - top) / shown_height * height).alias("py")))


def node_issues(issues: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """issues: issue, affected (array); nodes: node; anchors: node, anchor of either side. Issues that name the node or one of its anchors."""
    named = issues.select("issue", F.explode("affected").alias("id"))
    ids = nodes.select("node", F.col("node").cast("string").alias("id")).union(anchors.select("node", F.col("anchor").cast("string")))
    return named.join(ids, "id").select("node", "issue").distinct()


def node_records(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """nodes: node, record_ids (array); records: record, said. What is known of each node's origin, in order; unknown ids are left out."""
    rows = nodes.select("node", F.posexplode("record_ids").alias("pos", "record")).join(records, "record")
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda s: s["said"]).alias("said"))


def plain_text(text: Column, cells: Column, is_figure: Column, label: Column, math: list[Column]) -> Column:
    """The text of a node; else its first cells, its figure label, its mathematics, or that there is a preview."""
    shown = F.array_join(F.slice(cells, 1, 20), " | ")
    return (
        F.when(text.isNotNull(), text)
        .when(cells.isNotNull(), F.concat(shown, F.when(F.size(cells) > 20, "…").otherwise("")))
        .when(is_figure, F.concat(F.lit("Figure "), F.coalesce(label, F.lit(""))))
        .otherwise(F.coalesce(*math, F.lit("[preview]")))
    )


def slice_or(text: Column, start: Column, stop: Column, otherwise: str = "[out of range]") -> Column:
    """Code points start to stop, or a sign that they are not there."""
    fits = (start >= 0) & (stop >= start) & (stop <= F.length(text))
    return F.when(fits, F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))).otherwise(otherwise)


def citation_slices(marks: DataFrame) -> DataFrame:
    """marks: node, side, text, type, start, stop, label, target. Of citing marks on either side the text they stand on."""
    said = F.concat("type", F.when(F.col("label").isNotNull() & (F.col("label") != ""), F.concat(F.lit(" "), "label")).otherwise(""))
    return marks.where(F.col("type").isin(*CITATION_MARKS)).select("node", "side", "start", slice_or(F.col("text"), F.col("start"), F.col("stop")).alias("slice"), said.alias("label"), "target")


def bundle(documents: DataFrame, **parts: DataFrame) -> DataFrame:
    """doc, json: one text for each document with the given parts (tables with doc, pos and json of each element) as arrays in order."""
    out = documents.select("doc").distinct()
    for name, rows in parts.items():
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "json"))), lambda s: s["json"]), ","), F.lit("]"))
        out = out.join(rows.groupBy("doc").agg(listed.alias(name)), "doc", "left")
    body = F.concat_ws(",", F.lit(f'"viewerDataVersion":{BUNDLE_VERSION}'), *[F.concat(F.lit(f'"{n}":'), F.coalesce(n, F.lit("[]"))) for n in parts])
    return out.select("doc", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def bundle_errors(json: Column) -> Column:
    """The first thing wrong with a bundle, or null: its version, a missing array, a node without id, kind or score, an entry without node."""
    v = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    listed = lambda path: F.coalesce(F.startswith(kind(path), F.lit("ARRAY")), F.lit(False))
    nodes = F.from_json(json, "semanticNodes array<struct<id:string,kind:string,confidence:struct<score:double>>>, translation struct<entries:array<struct<semanticNodeId:string>>>")
    bad_node = F.exists(nodes["semanticNodes"], lambda n: n.isNull() | n["id"].isNull() | n["kind"].isNull())
    bad_score = F.exists(nodes["semanticNodes"], lambda n: n["confidence"]["score"].isNull())
    bad_entry = F.exists(nodes["translation"]["entries"], lambda e: e.isNull() | e["semanticNodeId"].isNull())
    out = F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "invalid mapping bundle").when(F.coalesce(F.try_variant_get(v, "$.viewerDataVersion", "int"), F.lit(0)) != BUNDLE_VERSION, "unsupported viewer data version")
    for name in ARRAYS:
        out = out.when(~listed(f"$.{name}"), F.lit(f"missing array {name}"))
    out = out.when(bad_node, "semantic node identity").when(bad_score, "semantic node confidence")
    return out.when(~listed("$.translation.entries"), "translation").when(bad_entry, "translation entry")


def pages_at(rows: DataFrame, pages: DataFrame, index: str = "page_index") -> DataFrame:
    """rows with the page that stands at their index in the document (doc, page, page_index); an index outside is an error."""
    known = pages.select("doc", F.col("page_index").alias(index), "page")
    said = F.concat(F.lit("page index "), F.col(index).cast("string"), F.lit(" is outside the document"))
    return rows.join(known, ["doc", index], "left").withColumn("page", F.coalesce("page", F.raise_error(said).cast("long")))
