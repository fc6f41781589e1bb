"""Page structure from boxes: bands and columns, blocks of lines, clusters of graphics, grids of cells, notes that go on.

What depends on the order in which boxes are met is a rule over the rows of one page (a list of dicts with x, y, w, h and more),
which walk() runs for many pages a call; what does not is a window or an aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .walk import walk

# Gaps that part strips and columns, and shares of the page's width that tell band modes apart.
STRIP_GAP, GUTTER_SHARE, GUTTER_LEAST, COLUMN_SHARE = 9.0, 0.015, 7.0, 0.15
FULL_WIDTH, INTERRUPTING = 0.6, 0.5
# Lines to blocks, by the body font.
LINE_GAP, LINE_GAP_LEAST, LINE_OVERLAP, INDENT = 0.75, 4.0, 0.4, 1.2
# Candidates of paragraphs, by the height of lines.
PARA_GAP, PARA_GAP_LEAST, PARA_OVERLAP = 0.9, 6.0, 0.5
# Graphics, notes, fragments of lines, cells.
GRAPHIC_GAP, NOTE_GAP, NOTE_OVERLAP = 12.0, 2.0, 0.5
MERGE_GAP, MERGE_OVERLAP, CELL_GAP = 6.0, 0.5, 3.0
LINE_NEAR, COLUMN_NEAR, GAP_SHARE, GRID_ROWS, CELL_INSIDE = 0.4, 8.0, 0.25, (2, 12), 0.7
# Weights of layout complexity, and the number of band modes.
VARIETY, GRAPHIC, MIXED, MODES = 0.4, 0.3, 0.3, 4
#: Characters and table pages from which a document is routed to specialists.
NATIVE_CHARS, TABLE_DENSITY, MATH_DENSITY = 20, 0.1, 0.05

_NOTE = re.compile(r"^(\d{1,2}[.\s]|[*†‡§¶]\s?)")


def _box(rows: list[dict]) -> tuple[float, float, float, float]:
    """Left, top, right and bottom of all."""
    return min(r["x"] for r in rows), min(r["y"] for r in rows), max(r["x"] + r["w"] for r in rows), max(r["y"] + r["h"] for r in rows)


def _islands(rows: list[dict], at: str, size: str, gap: float) -> list[list[dict]]:
    """Runs along an axis: a new one begins over `gap` beyond all before."""
    out: list[list[dict]] = []
    reach = 0.0
    for r in rows:
        if not out or r[at] - reach > gap:
            out.append([])
            reach = r[at] + r[size]
        out[-1].append(r)
        reach = max(reach, r[at] + r[size])
    return out


def columns(rows: list[dict], page_width: float) -> list[list[dict]]:
    """Columns of a strip, left to right; those narrower than COLUMN_SHARE of the page join the nearer neighbour, the left one if both are as near."""
    out = _islands(sorted(rows, key=lambda r: (r["x"], r["y"])), "x", "w", max(GUTTER_SHARE * page_width, GUTTER_LEAST))
    i = 0
    while i < len(out) and len(out) > 1:
        left, _, right, _ = _box(out[i])
        if right - left >= COLUMN_SHARE * page_width:
            i += 1
            continue
        before = left - _box(out[i - 1])[2] if i else float("inf")
        after = _box(out[i + 1])[0] - right if i + 1 < len(out) else float("inf")
        narrow = out.pop(i)
        # What stood after it now stands in its place.
        out[i - 1 if before <= after else i] += narrow
        out.sort(key=lambda c: _box(c)[0])
    return [sorted(c, key=lambda r: (r["y"], r["x"])) for c in out]


def page_bands(rows: list[dict]) -> Iterator[tuple]:
    """A strip over the full width is a band; its columns hold its items."""
    for band, strip in enumerate(_islands(sorted(rows, key=lambda r: (r["y"], r["x"])), "y", "h", STRIP_GAP)):
        found = columns(strip, strip[0]["page_width"])
        for n, column in enumerate(found):
            left, top, right, bottom = _box(column)
            for r in column:
                yield r["page"], r["item"], band, n, len(found), left, top, right - left, bottom - top


def bands(items: DataFrame) -> DataFrame:
    """items: page, item, x, y, w, h, page_width. Each with its band, its column, the number of columns and the column's box."""
    return walk(items, ["page"], ["y", "x", "item"], page_bands, "page long, item long, band long, col long, n_columns long, col_x double, col_y double, col_w double, col_h double")


def classified(items: DataFrame, placed: DataFrame) -> DataFrame:
    """doc, page, band, n_columns, y_start, y_end and mode. items also has doc and graphic; modes look at all columns of the document."""
    rows = placed.join(items.select("page", "item", "doc", "graphic", "page_width", "x", "y", "w", "h"), ["page", "item"])
    own = rows.groupBy("doc", "page", "band", "n_columns").agg(
        F.min("y").alias("y_start"), F.max(F.col("y") + F.col("h")).alias("y_end"), F.max("graphic").alias("graphic"), (F.max("col_w") / F.max("page_width")).alias("share")
    )
    several = F.max(F.col("n_columns") >= 2).over(Window.partitionBy("doc"))
    share = F.when(F.col("n_columns") == 1, F.col("share")).otherwise(0.0)
    mode = (
        F.when(F.col("n_columns") >= 2, "MULTI_COLUMN")
        .when(F.col("graphic") & (share >= INTERRUPTING) & (several | (share >= FULL_WIDTH)), "SPANNING")
        .when(several & (share >= FULL_WIDTH), "FULL_WIDTH")
        .otherwise("SINGLE_COLUMN")
    )
    return own.select("doc", "page", "band", "n_columns", "y_start", "y_end", mode.alias("mode"))


def mode_of(value: Column, order: Column) -> Column:
    """An aggregate over counted values: the most frequent, of equally frequent ones the first met. Rows are (value, n, first)."""
    return F.max_by(value, F.struct("n", -order))


def probe(pages: DataFrame, modes: DataFrame) -> DataFrame:
    """pages: doc, page, chars, math, has_table, graphic_share, has_text; modes as classified() gives them. One row a document."""
    text = modes.join(pages.where("has_text").select("page").distinct(), "page", "left_semi")
    per_page = text.groupBy("doc", "page", "n_columns").agg(F.count("*").alias("n"), F.min("band").alias("_f"))
    per_page = per_page.groupBy("doc", "page").agg(mode_of(F.col("n_columns"), F.col("_f")).alias("n_columns"))
    counts = per_page.groupBy("doc", "n_columns").agg(F.count("*").alias("n"), F.min("page").alias("_f"))
    columns_ = counts.groupBy("doc").agg(mode_of(F.col("n_columns"), F.col("_f")).alias("estimated_columns"), (1 - F.max("n") / F.sum("n")).alias("_mixed"))
    variety = text.groupBy("doc").agg(F.size(F.collect_set("mode")).alias("_modes"))
    share = lambda c: F.avg(c.cast("int"))
    whole = pages.groupBy("doc").agg(
        share(F.col("chars") >= NATIVE_CHARS).alias("native_text_ratio"),
        F.when(F.sum("chars") > 0, F.sum("math") / F.sum("chars")).otherwise(0.0).alias("math_density"),
        share(F.col("has_table")).alias("table_density"),
        F.avg(F.least("graphic_share", F.lit(1.0))).alias("image_density"),
    )
    rows = whole.join(columns_, "doc", "left").join(variety, "doc", "left")
    complexity = VARIETY * F.greatest(F.coalesce("_modes", F.lit(0)) - 1, F.lit(0)) / (MODES - 1) + GRAPHIC * F.col("image_density") + MIXED * F.coalesce("_mixed", F.lit(0.0))
    return rows.withColumn("layout_complexity", F.least(F.lit(1.0), complexity)).withColumn("scanned_page_ratio", 1 - F.col("native_text_ratio")).drop("_modes", "_mixed")


def routes(probed: DataFrame, primaries: dict[str, str]) -> DataFrame:
    """doc, provider, capabilities, reason: the providers a document goes to; a document without native text is refused."""
    number = lambda c: F.format_number(c, 2)
    mathy = F.col("math_density") >= MATH_DENSITY
    layout = F.struct(
        F.lit(primaries["layout.region"]).alias("provider"),
        F.when(mathy, "layout.region,formula.detection").otherwise("layout.region").alias("capabilities"),
        F.concat(
            F.lit(f"layout.region primary {primaries['layout.region']}"),
            F.when(mathy, F.concat(F.lit("; math density "), number(F.col("math_density")), F.lit(f" >= {MATH_DENSITY}"))).otherwise(""),
            F.when(F.col("estimated_columns") > 1, F.concat(F.lit("; estimated columns "), F.col("estimated_columns").cast("string"))).otherwise(""),
        ).alias("reason"),
    )
    table = F.struct(
        F.lit(primaries["table.structure"]).alias("provider"), F.lit("table.structure,table.detection").alias("capabilities"),
        F.concat(F.lit("table density "), number(F.col("table_density")), F.lit(f" >= {TABLE_DENSITY}")).alias("reason"),
    )
    scholarly = F.struct(
        F.lit(primaries["scholarly.metadata"]).alias("provider"), F.lit("scholarly.metadata,scholarly.bibliography").alias("capabilities"),
        F.lit("scholarly metadata/bibliography primary (standard paper route)").alias("reason"),
    )
    refused = F.struct(F.lit("refused").alias("provider"), F.lit("").alias("capabilities"), F.lit("document has no native text layer on any page").alias("reason"))
    apart = F.lit(primaries["table.structure"] != primaries["layout.region"])
    plan = F.when(F.col("native_text_ratio") == 0, F.array(refused)).otherwise(F.array_compact(F.array(layout, F.when(apart & (F.col("table_density") >= TABLE_DENSITY), table), scholarly)))
    return probed.select("doc", F.explode(plan).alias("p")).select("doc", "p.*")


def _overlap(a: tuple, b: tuple) -> float:
    narrow = min(a[2] - a[0], b[2] - b[0])
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) / narrow if narrow > 0 else 0.0


def _gap(a: tuple, b: tuple) -> float:
    """Vertical distance of two boxes, 0 if they share a height."""
    return max(b[1] - a[3], a[1] - b[3], 0.0)


def line_blocks(rows: list[dict]) -> Iterator[tuple]:
    """Each line joins the compatible open block that is nearest above it; one that begins with a note's marker opens its own."""
    body = rows[0]["body_font"] or 0.0
    gap_most = max(LINE_GAP_LEAST, LINE_GAP * body) if body > 0 else LINE_GAP_LEAST
    blocks: list[list[dict]] = []
    for r in rows:
        own, best = _box([r]), None
        if not _NOTE.match(r["text"].strip()):
            for block in blocks:
                box = _box(block)
                gap = _gap(box, own)
                far = gap > gap_most or r["y"] < box[1] - (r["h"] or 1.0)
                if far or _overlap(box, own) < LINE_OVERLAP or body > 0 and r["x"] >= box[0] + INDENT * body:
                    continue
                if best is None or gap < best[0]:
                    best = gap, block
        if best:
            best[1].append(r)
        else:
            blocks.append([r])
    for n, block in enumerate(blocks):
        left, top, right, bottom = _box(block)
        font, text = max(r["font"] for r in block), " ".join(r["text"] for r in sorted(block, key=lambda r: (r["y"], r["x"])))
        head = body > 0 and font / body >= R.HEADING_FONT and "=" not in text and len(text) <= 120 and len(block) <= 2
        for r in block:
            yield r["page"], r["item"], n, "HEADING_LIKE" if head else "PARAGRAPH_LIKE", 0.6 if head else 0.75, left, top, right - left, bottom - top


def blocks(lines: DataFrame) -> DataFrame:
    """lines: page, item, x, y, w, h, font, text, body_font. Each with its block, the block's label, confidence and box."""
    return walk(lines, ["page"], ["y", "x", "item"], line_blocks, "page long, item long, block long, label string, confidence double, x double, y double, w double, h double")


def candidate_clusters(rows: list[dict]) -> Iterator[tuple]:
    """As blocks, but a line is held against the last line of each cluster only."""
    clusters: list[list[dict]] = []
    for r in rows:
        own, best = _box([r]), None
        for cluster in clusters:
            last = _box([cluster[-1]])
            gap = _gap(last, own)
            if _overlap(last, own) >= PARA_OVERLAP and gap <= max(PARA_GAP_LEAST, PARA_GAP * max(r["h"] or 1.0, cluster[-1]["h"])) and (best is None or gap < best[0]):
                best = gap, cluster
        if best:
            best[1].append(r)
        else:
            clusters.append([r])
    for n, cluster in enumerate(clusters):
        left, top, right, bottom = _box(cluster)
        yield cluster[0]["page"], n, " ".join(r["text"] for r in cluster), max(r["font"] if r["font"] > 0 else r["h"] for r in cluster), len(cluster), cluster[0]["body_font"], left, top, right - left, bottom - top


def candidates(lines: DataFrame) -> DataFrame:
    """Candidates of regions, as a parser would give them: label by caption, formula, size, else paragraph, with its confidence and a preview."""
    rows = walk(lines, ["page"], ["y", "x", "item"], candidate_clusters, "page long, cluster long, text string, font double, n_lines long, body_font double, x double, y double, w double, h double")
    t = F.col("text")
    head = (F.col("body_font") > 0) & (F.col("font") >= R.HEADING_FONT * F.col("body_font")) & (F.length(t) <= 120) & ~t.contains("=") & (F.col("n_lines") <= 2)
    named = lambda label, native, confidence: F.struct(F.lit(label).alias("label"), F.lit(native).alias("native"), F.lit(confidence).alias("confidence"))
    kind = F.when(t.rlike(R.CAPTION), named("CAPTION_LIKE", "caption", 0.75)).when(R.looks_like_formula(t), named("FORMULA", "formula", 0.5)).when(head, named("HEADING_LIKE", "title", 0.65)).otherwise(named("PARAGRAPH_LIKE", "para", 0.6))
    return rows.select("page", "cluster", kind.alias("k"), F.left(t, F.lit(200)).alias("preview"), "x", "y", "w", "h").select("page", "cluster", "k.*", "preview", "x", "y", "w", "h")


def graphic_clusters(rows: list[dict]) -> Iterator[tuple]:
    """Graphics join the first cluster that they touch from below; then clusters whose boxes are near in both directions merge until none are."""
    found: list[list[dict]] = []
    for r in rows:
        for cluster in found:
            left, _, right, bottom = _box(cluster)
            if r["y"] - bottom <= GRAPHIC_GAP and min(right, r["x"] + r["w"]) - max(left, r["x"]) > 0:
                cluster.append(r)
                break
        else:
            found.append([r])
    i = 0
    while i < len(found):
        a = _box(found[i])
        for j in range(i + 1, len(found)):
            b = _box(found[j])
            if max(a[1] - b[3], b[1] - a[3], 0.0) <= GRAPHIC_GAP and max(a[0] - b[2], b[0] - a[2], 0.0) <= GRAPHIC_GAP:
                found[i] += found.pop(j)
                i = -1
                break
        i += 1
    for cluster in found:
        left, top, right, bottom = _box(cluster)
        yield cluster[0]["page"], min(r["item"] for r in cluster), len(cluster), left, top, right - left, bottom - top


def graphics(items: DataFrame) -> DataFrame:
    """items: page, item, x, y, w, h of graphics. Clusters by their smallest item; those under 2 points thick are rules, not figures."""
    rows = walk(items, ["page"], ["y", "x", "item"], graphic_clusters, "page long, cluster long, n_items long, x double, y double, w double, h double")
    return rows.where("w >= 2 AND h >= 2")


def note_flow(rows: list[dict]) -> Iterator[tuple]:
    """Notes of a page, and small texts below them that go on a note; those found may be gone on in turn."""
    notes = [r for r in rows if r["is_note"]]
    out = [r["item"] for r in notes]
    for r in rows:
        if r["is_note"] or not r["may_go_on"]:
            continue
        for note in sorted(notes, key=lambda n: (n["y"], n["x"])):
            gap = r["y"] - note["y"] - note["h"]
            if 0 <= gap <= NOTE_GAP * max(r["font"], note["font"], 1.0) and _overlap(_box([note]), _box([r])) >= NOTE_OVERLAP:
                out.append(r["item"])
                notes.append(r)
                break
    yield from ((rows[0]["page"], item, n) for n, item in enumerate(out))


def footnotes(regions: DataFrame) -> DataFrame:
    """regions: page, item, kind, label, text, x, y, w, h, font, page_height, body_font. The notes of each page in the order found."""
    zone = (F.col("page_height") > 0) & (F.col("y") >= R.NOTE_ZONE * F.col("page_height")) & ~((F.col("body_font") > 0) & (F.col("font") > R.NOTE_FONT * F.col("body_font")))
    text = (F.col("kind") == "TEXT") & ~F.col("label").isin("HEADING_LIKE", "CAPTION_LIKE")
    own = R.is_footnote(F.col("kind"), F.col("label"), F.col("text"), F.col("y"), F.col("font"), F.col("page_height"), F.col("body_font"))
    rows = regions.select("page", "item", "x", "y", "w", "h", "font", own.alias("is_note"), (text & zone).alias("may_go_on")).where("is_note OR may_go_on")
    return walk(rows, ["page"], ["y", "x", "item"], note_flow, "page long, item long, position long")


def merged_fragments(rows: list[dict]) -> Iterator[tuple]:
    """Fragments in stream order: one that shares half the height with the last and follows within MERGE_GAP goes on it."""
    out: list[list] = []
    for r in rows:
        left, top, right, bottom = r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]
        if out:
            last = out[-1]
            least, gap = min(last[3] - last[1], bottom - top), left - last[2]
            if least > 0 and (min(last[3], bottom) - max(last[1], top)) / least >= MERGE_OVERLAP and 0 <= gap <= MERGE_GAP:
                out[-1] = [last[0], min(last[1], top), max(last[2], right), max(last[3], bottom), last[4] + (" " if gap > 1.0 else "") + r["text"], max(last[5], r["font"])]
                continue
        out.append([left, top, right, bottom, r["text"], r["font"]])
    for n, (left, top, right, bottom, text, font) in enumerate(out):
        yield rows[0]["page"], n, left, top, right - left, bottom - top, text, font


def merge_fragments(fragments: DataFrame, page_type: str = "long") -> DataFrame:
    """fragments: page, seq, x, y, w, h, text, font."""
    return walk(fragments, ["page"], ["seq"], merged_fragments, f"page {page_type}, line long, x double, y double, w double, h double, text string, font double")


def split_cells(rows: list[dict]) -> Iterator[tuple]:
    """Characters in order: a printable one over CELL_GAP fonts beyond the last printable one begins a new piece; space between pieces goes."""
    pieces: list[list] = []
    pending = ""
    threshold = CELL_GAP * max(rows[0]["font"], 1.0)
    for r in rows:
        if not r["char"].strip():
            pending += r["char"] if pieces else ""
            continue
        if not pieces or r["x"] - pieces[-1][1] > threshold:
            pieces.append([r["x"], r["x"] + r["w"], r["char"]])
        else:
            last = pieces[-1]
            last[1], last[2] = max(last[1], r["x"] + r["w"]), last[2] + pending + r["char"]
        pending = ""
    for n, (left, right, text) in enumerate(pieces):
        yield rows[0]["rect"], n, left, right - left, text


def cells_of_rects(chars: DataFrame, rect_type: str = "long") -> DataFrame:
    """chars: rect, seq, char, x, w, font."""
    return walk(chars, ["rect"], ["seq"], split_cells, f"rect {rect_type}, piece long, x double, w double, text string")


def _lines(rows: list[dict]) -> list[list[dict]]:
    """Visual lines of rows in (y, x) order."""
    out: list[list[dict]] = []
    for r in rows:
        if out:
            last = out[-1][-1]
            if abs(r["y"] - last["y"]) <= LINE_NEAR * max(r["h"], last["h"]) or r["y"] < last["y"] + last["h"] and last["y"] < r["y"] + r["h"]:
                out[-1].append(r)
                continue
        out.append([r])
    return out


def centres(xs: list[float]) -> list[float]:
    """Left edges that are no nearer than COLUMN_NEAR to the one before."""
    out: list[float] = []
    for x in sorted(xs):
        if not out or abs(x - out[-1]) > COLUMN_NEAR:
            out.append(x)
    return out


def _separated(rows: list[dict], n: int) -> bool:
    """Whether n columns keep a gap of GAP_SHARE of the narrower one between neighbours."""
    if n < 2:
        return True
    seeds = centres([round(r["x"], 1) for r in rows])
    while len(seeds) > n:
        i = min(range(len(seeds) - 1), key=lambda i: seeds[i + 1] - seeds[i])
        seeds[i : i + 2] = [(seeds[i] + seeds[i + 1]) / 2]
    held: list[list[dict]] = [[] for _ in range(n)]
    for r in rows:
        held[min(range(len(seeds)), key=lambda i: abs(r["x"] - seeds[i]))].append(r)
    if not all(held):
        return False
    edges = sorted((_box(c)[0], _box(c)[2]) for c in held)
    return all(b[0] - a[1] >= GAP_SHARE * max(min(a[1] - a[0], b[1] - b[0]), 1.0) for a, b in zip(edges, edges[1:], strict=False))


def grid_cells(rows: list[dict]) -> Iterator[tuple]:
    """Runs of lines with as many columns at the same places are grids; each span is a cell by its line and its nearest column."""
    runs: list[list[list[dict]]] = [[]]
    before: list[float] = []
    for line in _lines(rows):
        own = centres([r["x"] for r in line])
        if len(line) < 2:
            runs.append([])
            continue
        if runs[-1] and not (len(own) == len(before) and all(abs(a - b) <= COLUMN_NEAR for a, b in zip(own, before, strict=True))):
            runs.append([])
        runs[-1].append(line)
        before = own
    number = 0
    for run in runs:
        flat = [r for line in run for r in line]
        if not GRID_ROWS[0] <= len(run) <= GRID_ROWS[1] or not _separated(flat, len(centres([r["x"] for r in run[-1]]))):
            continue
        left, top, right, bottom = _box(flat)
        inside = [r for r in rows if r["w"] * r["h"] > 0 and max(min(right, r["x"] + r["w"]) - max(left, r["x"]), 0.0) * max(min(bottom, r["y"] + r["h"]) - max(top, r["y"]), 0.0) / (r["w"] * r["h"]) >= CELL_INSIDE]
        seeds = centres([r["x"] for r in inside])
        for n, line in enumerate(_lines(inside)):
            for r in line:
                middle = r["x"] + r["w"] / 2
                yield r["page"], number, n, min(range(len(seeds)), key=lambda i: abs(middle - seeds[i])), r["item"], left, top, right - left, bottom - top
        number += 1


def grids(spans: DataFrame) -> DataFrame:
    """spans: page, item, x, y, w, h. page, grid, row, col and item of each cell, with the grid's box."""
    return walk(spans, ["page"], ["y", "x", "item"], grid_cells, "page long, grid long, row long, col long, item long, x double, y double, w double, h double")


def placed_orphans(regions: DataFrame, columns: DataFrame, page_width: float) -> DataFrame:
    """regions: page, region, x, y, w, h; columns: page, band, col, cx, cw, y0, y1. Of each region the column of which it holds the greatest share, else the outer one of the band it overlaps most, by its half of the page."""
    zero = F.lit(0.0)
    overlap = F.greatest(F.least(F.col("y") + F.col("h"), F.col("y1")) - F.greatest("y", "y0"), zero)
    wide = F.greatest(F.least(F.col("x") + F.col("w"), F.col("cx") + F.col("cw")) - F.greatest("x", "cx"), zero)
    rows = regions.select("page", "region", "x", "y", "w", "h").join(columns, "page").withColumn("overlap", overlap).withColumn("inside", wide * F.col("overlap") / (F.col("cw") * (F.col("y1") - F.col("y0"))))
    last = F.max("col").over(Window.partitionBy("region", "band"))
    rows = rows.withColumn("last", last)
    first = -F.col("band"), -F.col("col")
    best = rows.groupBy("region").agg(
        F.max_by(F.struct("band", "col", "inside"), F.struct("inside", *[c.alias(f"o{i}") for i, c in enumerate(first)])).alias("b"), F.max_by(F.struct("band", "last"), F.struct("overlap", first[0].alias("o"))).alias("f"), F.max(F.col("x") + F.col("w") / 2).alias("centre")
    )
    use = F.col("b.inside") > 0
    return best.select("region", F.when(use, F.col("b.band")).otherwise(F.col("f.band")).cast("long").alias("band"), F.when(use, F.col("b.col")).when(F.col("centre") < page_width / 2, 0).otherwise(F.col("f.last")).cast("long").alias("col"))
