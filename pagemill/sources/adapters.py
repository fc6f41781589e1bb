"""Parser dumps (JSON, TEI) as rows of candidates: page (from 0), x, y, w, h, native label, text, confidence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.walk import walk

# Confidence of each kind of evidence, and the length of previews.
TEXT_CONFIDENCE, TABLE_CONFIDENCE, BLOCK_CONFIDENCE, FORMULA_CONFIDENCE, SECTION_CONFIDENCE = 0.8, 0.88, 0.82, 0.8, 0.85
PREVIEW = 200
#: Types of blocks that are formulas, and roles of sections; other roles that are not empty are sections.
FORMULAS = ("display_formula", "inline_formula", "equation", "formula")
ROLES = {"title": "TITLE", "abstract": "ABSTRACT", "section": "SECTION", "subsection": "SUBSECTION", "acknowledgement": "ACKNOWLEDGEMENT", "acknowledgments": "ACKNOWLEDGEMENT", "references": "REFERENCES", "bibliography": "REFERENCES"}

# Fields of a dump as from_json takes them; those that differ in kind are variants.
_PLACE = "prov:array<struct<page_no:variant,page:variant,bbox:variant>>,bbox:variant,page_idx:variant,page:variant"
_CELL = "struct<start_row_offset_idx:variant,row:variant,end_row_offset_idx:variant,row_span:variant,rowSpan:variant,start_col_offset_idx:variant,column:variant,end_col_offset_idx:variant,col_span:variant,colSpan:variant,text:string>"
_DATA = f"num_rows:variant,num_cols:variant,table_cells:array<{_CELL}>,grid:array<array<{_CELL}>>"
DOCLING = f"texts array<struct<{_PLACE},label:string,text:string>>"
TABLES = f"tables array<struct<{_PLACE},data:struct<{_DATA}>,{_DATA}>>"
_BLOCK = "struct<type:string,label:string,bbox:variant,latex:string,latex_text:string,mathml:string,text:string,content:string,lines:array<struct<spans:array<struct<content:string>>>>>"
BLOCKS = f"pdf_info array<struct<page_idx:bigint,para_blocks:array<{_BLOCK}>,preproc_blocks:array<{_BLOCK}>>>, middle struct<para_blocks:array<{_BLOCK}>>, para_blocks array<{_BLOCK}>"
SCHOLARLY = "title variant, author variant, authors variant, abstract variant, sections array<struct<role:string,text:string,page_idx:bigint,bbox:variant>>"


def _get(v: Column, path: str, kind: str = "double") -> Column:
    return F.try_variant_get(v, path, kind)


def box(b: Column, page_height: Column) -> Column:
    """struct<x, y, w, h> of a box given by place and size, by sides, or by corners; sides from the bottom are flipped with the page's height. Other forms, and a missing height, are errors; null stays null."""
    number = lambda path: _get(b, path)
    struct = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    sized = number("$.x").isNotNull() & number("$.y").isNotNull() & number("$.width").isNotNull() & number("$.height").isNotNull()
    sided = number("$.l").isNotNull() & number("$.t").isNotNull() & number("$.r").isNotNull() & number("$.b").isNotNull()
    four = number("$[3]").isNotNull() & _get(b, "$[4]", "variant").isNull()
    origin = F.upper(F.replace(F.coalesce(_get(b, "$.coord_origin", "string"), _get(b, "$.coordOrigin", "string"), F.lit("TOPLEFT")), F.lit("-"), F.lit("_")))
    height = F.coalesce(page_height, F.raise_error(F.lit("a box from the bottom needs the page's height")).cast("double"))
    flip = lambda y: F.when(origin.isin("BOTTOMLEFT", "BOTTOM_LEFT"), height - y).otherwise(y)
    top, bottom, left, right = flip(number("$.t")), flip(number("$.b")), number("$.l"), number("$.r")
    by_sides = struct(F.least(left, right), F.least(top, bottom), F.abs(right - left), F.abs(bottom - top))
    by_corners = struct(number("$[0]"), number("$[1]"), number("$[2]") - number("$[0]"), number("$[3]") - number("$[1]"))
    bad = F.raise_error(F.concat(F.lit("unsupported box: "), F.to_json(b))).cast("struct<x:double,y:double,w:double,h:double>")
    return F.when(b.isNull() | F.is_variant_null(b), F.lit(None)).when(sized, struct(number("$.x"), number("$.y"), number("$.width"), number("$.height"))).when(sided, by_sides).when(four, by_corners).otherwise(bad)


def count_of(*values: Column) -> Column:
    """The first value that is a number or the text of a whole one; truth values are none; 0 without any."""
    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        return F.when(kind == "BOOLEAN", None).when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).cast("long"))).otherwise(F.try_variant_get(v, "$", "double").cast("long"))

    return F.coalesce(*[one(v) for v in values], F.lit(0).cast("long"))


def _located(rows: DataFrame, item: str, page_height: float) -> DataFrame:
    """rows with the page (from 0) and box of a dump item: by its first provenance, whose pages count from 1, else by itself."""
    first = F.try_element_at(F.col(f"{item}.prov"), F.lit(1))
    by_first = first.isNotNull()
    page = F.when(by_first, F.greatest(F.when(first["page_no"].isNull() & first["page"].isNull(), 1).otherwise(count_of(first["page_no"], first["page"])) - 1, F.lit(0))).otherwise(F.greatest(count_of(F.col(f"{item}.page_idx"), F.col(f"{item}.page")), F.lit(0)))
    bbox = F.when(by_first & first["bbox"].isNotNull(), first["bbox"]).otherwise(F.col(f"{item}.bbox"))
    return rows.withColumn("page", page.cast("long")).withColumn("box", box(bbox, F.lit(page_height)))


def docling_regions(dumps: DataFrame, page_height: float, key: str = "doc_id", json: str = "json") -> DataFrame:
    """Text regions."""
    rows = dumps.select(key, F.posexplode(F.from_json(json, DOCLING)["texts"]).alias("pos", "t"))
    rows = _located(rows, "t", page_height).where("box IS NOT NULL")
    return rows.select(key, "pos", "page", "box.*", F.coalesce("t.label", F.lit("paragraph")).alias("label"), F.substring(F.coalesce("t.text", F.lit("")), 1, PREVIEW).alias("text"), F.lit(TEXT_CONFIDENCE).alias("confidence"))


def _uncovered(rows: list[dict]) -> Iterator[tuple]:
    """Cells of one table; of a grid those that stand at their own place, which no cell before them covers."""
    covered: set[tuple[int, int]] = set()
    for r in rows:
        at = r["row"], r["col"]
        if r["y"] is not None:
            if (r["y"], r["x"]) in covered or (r["y"], r["x"]) != at:
                continue
            covered |= {(at[0] + i, at[1] + j) for i in range(r["row_span"]) for j in range(r["col_span"])}
        yield r["doc"], r["tab"], *at, r["row_span"], r["col_span"], r["text"]


def table_cells(dumps: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """doc, tab, row, col, row_span, col_span, text of the cells of all tables: those listed, else those of the grid, in which a wide cell stands at each place it covers."""
    tables = dumps.select(F.col(key).alias("doc"), F.posexplode(F.from_json(json, TABLES)["tables"]).alias("tab", "t"))
    data = F.coalesce("t.data", F.struct(*[F.col(f"t.{c}").alias(c) for c in ("num_rows", "num_cols", "table_cells", "grid")]))
    tables = tables.select("doc", "tab", data.alias("d"))
    listed = F.size(F.coalesce("d.table_cells", F.array())) > 0
    own = tables.where(listed).select("doc", "tab", F.posexplode("d.table_cells").alias("seq", "c")).select("doc", "tab", F.lit(0).alias("line"), "seq", F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("x"), "c")
    grid = tables.where(~listed).select("doc", "tab", F.posexplode("d.grid").alias("line", "r")).select("doc", "tab", "line", F.posexplode("r").alias("seq", "c"))
    grid = grid.select("doc", "tab", "line", "seq", F.col("line").cast("long").alias("y"), F.col("seq").cast("long").alias("x"), "c")
    rows = own.union(grid).where("c IS NOT NULL")
    c = lambda name: F.col(f"c.{name}")
    origin = lambda a, b, place: F.when(c(a).isNull() & c(b).isNull(), F.coalesce(place, F.lit(0))).otherwise(count_of(c(a), c(b)))
    row, col = origin("start_row_offset_idx", "row", F.col("y")), origin("start_col_offset_idx", "column", F.col("x"))
    span = lambda end, a, b, start: F.greatest(F.when(c(end).isNotNull(), count_of(c(end)) - start).otherwise(F.when(c(a).isNull() & c(b).isNull(), 1).otherwise(count_of(c(a), c(b)))), F.lit(1)).cast("long")
    rows = rows.select("doc", "tab", "line", "seq", "y", "x", row.alias("row"), col.alias("col"), span("end_row_offset_idx", "row_span", "rowSpan", row).alias("row_span"), span("end_col_offset_idx", "col_span", "colSpan", col).alias("col_span"), F.coalesce("c.text", F.lit("")).alias("text"))
    return walk(rows.withColumn("tab", F.col("tab").cast("long")), ["doc", "tab"], ["line", "seq"], _uncovered, "doc long, tab long, row long, col long, row_span long, col_span long, text string")


def docling_tables(dumps: DataFrame, page_height: float, key: str = "doc_id", json: str = "json") -> DataFrame:
    """doc, tab, page, box, numbers of rows and columns (counted from the cells where the dump has none) and confidence of all tables."""
    tables = dumps.select(F.col(key).alias("doc"), F.posexplode(F.from_json(json, TABLES)["tables"]).alias("tab", "t"))
    given = lambda n: F.when(F.col("t.data").isNotNull(), count_of(F.col(f"t.data.{n}"))).otherwise(count_of(F.col(f"t.{n}")))
    tables = _located(tables, "t", page_height).select("doc", F.col("tab").cast("long").alias("tab"), "page", "box.*", given("num_rows").alias("_r"), given("num_cols").alias("_c"))
    size = table_cells(dumps, key, json).groupBy("doc", "tab").agg(F.max(F.col("row") + F.col("row_span")).alias("_mr"), F.max(F.col("col") + F.col("col_span")).alias("_mc"))
    least = lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), b, F.lit(0)).cast("long")
    # Neither side is bounded: no broadcast, at any size.
    return tables.hint("merge").join(size, ["doc", "tab"], "left").select("doc", "tab", "page", "x", "y", "w", "h", least("_r", F.col("_mr")).alias("n_rows"), least("_c", F.col("_mc")).alias("n_columns"), F.lit(TABLE_CONFIDENCE).alias("confidence"))


def block_regions(dumps: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """Blocks of pages, from any of three layouts; those without a box are dropped, and a missing text is that of the block's lines."""
    d = F.from_json(json, BLOCKS)
    filled = lambda a: F.size(F.coalesce(a, F.array())) > 0
    paged = F.transform(d["pdf_info"], lambda p, i: F.struct(F.coalesce(p["page_idx"], i.cast("long")).alias("page"), F.when(filled(p["para_blocks"]), p["para_blocks"]).otherwise(p["preproc_blocks"]).alias("blocks")))
    alone = lambda blocks: F.array(F.struct(F.lit(0).cast("long").alias("page"), blocks.alias("blocks")))
    pages = F.when(filled(d["pdf_info"]), paged).when(d["middle"].isNotNull(), alone(d["middle"]["para_blocks"])).otherwise(alone(d["para_blocks"]))
    rows = dumps.select(key, F.explode(pages).alias("g")).select(key, "g.page", F.posexplode("g.blocks").alias("pos", "b"))
    rows = rows.withColumn("box", box(F.col("b.bbox"), F.lit(None).cast("double"))).where("box IS NOT NULL")
    label = F.coalesce(F.nullif("b.type", F.lit("")), F.nullif("b.label", F.lit("")), F.lit("text"))
    lines = F.trim(F.array_join(F.flatten(F.transform("b.lines", lambda x: F.transform(x["spans"], lambda s: s["content"]))), " "))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.coalesce(full("b.text"), full("b.content"), lines, F.lit(""))
    formula = F.lower(label).isin(*FORMULAS)
    latex = F.coalesce(full("b.latex"), full("b.latex_text"))
    shown = F.when(formula, F.coalesce(F.nullif(text, F.lit("")), latex, F.lit("[formula]"))).otherwise(F.left(text, F.lit(PREVIEW)))
    return rows.select(key, "page", "pos", "box.*", label.alias("label"), F.when(formula, "FORMULA").otherwise("REGION").alias("type"), shown.alias("text"), F.when(formula, latex).alias("latex"), F.when(formula, FORMULA_CONFIDENCE).otherwise(BLOCK_CONFIDENCE).alias("confidence"))


def scholarly_sections(dumps: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """Sections with their role, page and, where given, box."""
    rows = dumps.select(key, F.posexplode(F.from_json(json, SCHOLARLY)["sections"]).alias("pos", "s"))
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    rows = rows.withColumn("box", box(F.col("s.bbox"), F.lit(None).cast("double")))
    role = F.coalesce(F.element_at(table, F.lower(F.trim(F.coalesce(F.nullif("s.role", F.lit("")), F.lit("SECTION"))))), F.lit("SECTION"))
    return rows.select(key, "pos", F.coalesce("s.page_idx", F.lit(0)).alias("page"), role.alias("role"), F.left(F.coalesce("s.text", F.lit("")), F.lit(PREVIEW)).alias("text"), "box.x", "box.y", "box.w", "box.h", F.lit(SECTION_CONFIDENCE).alias("confidence"))


def scholarly_metadata(dumps: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """Title, author and abstract that are texts and not blank; a list of authors is joined."""
    m = F.from_json(json, SCHOLARLY)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))
    listed = F.array_join(F.filter(F.try_variant_get(F.coalesce(m["author"], m["authors"]), "$", "array<string>"), lambda a: F.trim(a) != ""), ", ")
    author = F.coalesce(text(F.coalesce(m["author"], m["authors"])), F.nullif(listed, F.lit("")))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = F.array(field("title", text(m["title"])), field("author", author), field("abstract", text(m["abstract"])))
    return dumps.select(key, F.explode(F.filter(fields, lambda f: f["value"].isNotNull())).alias("f")).select(key, "f.*")


def _plain(xml: Column) -> Column:
    """The text of a piece of XML, one space between what its elements hold."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(xml, "<[^>]*>", " "), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def tei_metadata(dumps: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Of TEI documents title, author (of the source, else of the file, else anywhere), abstract, heads, and whether there are references: name, value, in order."""
    inside = lambda x, name: F.regexp_extract(x, rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*)</(?:\w+:)?{name}>", 1)
    first = lambda x, name: _plain(F.regexp_extract(x, rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1))
    every = lambda x, name: F.filter(F.transform(F.regexp_extract_all(x, F.lit(rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>"), F.lit(1)), _plain), lambda t: t != "")
    of_type = lambda x, kind: _plain(F.regexp_extract(x, rf"""(?s)<(?:\w+:)?div\b[^>]*type=["']{kind}["'][^>]*>(.*?)</(?:\w+:)?div>""", 1))
    t = F.col(xml)
    full = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(full(first(inside(t, "titleStmt"), "title")), full(first(inside(t, "docTitle"), "titlePart")))
    source, file = every(inside(t, "sourceDesc"), "persName"), every(inside(t, "fileDesc"), "persName")
    names = F.when(F.size(source) > 0, source).when(F.size(file) > 0, file).otherwise(every(t, "persName"))
    abstract = F.coalesce(full(first(inside(t, "profileDesc"), "abstract")), full(of_type(t, "abstract")))
    refers = t.rlike(r"""<(?:\w+:)?listBibl\b|<(?:\w+:)?div\b[^>]*type=["']references["']""")
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    one = F.array(field("title", title), field("author", full(F.array_join(names, ", "))), field("abstract", abstract))
    heads = F.transform(every(inside(t, "body"), "head"), lambda h: field("head", h))
    fields = F.concat(one, heads, F.array(field("references", F.when(refers, "References"))))
    return dumps.select(key, F.explode(F.filter(fields, lambda f: f["value"].isNotNull())).alias("f")).select(key, "f.*")
