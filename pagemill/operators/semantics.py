"""From regions in reading order to the nodes of a document: roles, headings, paragraphs, equations, notes, citations, marks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .walk import walk

# Confidence of nodes by what they came from.
CONFIDENCE = {"DOCUMENT": 1.0, "HEADING": 0.6, "PARAGRAPH": 0.8, "MERGED": 0.75, "FIGURE": 0.7, "CAPTION": 0.7, "FOOTNOTE": 0.7, "SECTION": 0.65, "FRONT_MATTER": 0.65, "EQUATION": 0.55, "BIBLIOGRAPHY": 0.7, "ENTRY": 0.75, "TABLE": 0.8, "TABLE_LINES": 0.6}
# Fragments of displayed equations, and what leads in to them.
FRAGMENT_LINES, LEAD_IN = 3, 60
# Scores of references to notes.
LINK_LEAST, AMBIGUOUS = 0.6, 0.15
# Metadata of the first page.
METADATA_FIRST, TITLE_MATCH, ABSTRACT_MOST, ABSTRACT_LINES = 8, 40, 600, 3
SMALL_AUTHOR, INLINE_MOST = 0.85, 40


def with_heading(flow: DataFrame) -> DataFrame:
    """flow (text, label) with level and numbering of headings."""
    return flow.withColumn("_h", R.heading(F.col("text"), F.col("label"))).withColumn("level", F.col("_h.level")).withColumn("numbering", F.col("_h.numbering")).drop("_h")


def _front_roles(rows: list[dict]) -> Iterator[tuple]:
    """Title, abstract and what stands between, up to the first heading of the body, its first sentence, or the end of the abstract."""
    title = abstract = -1
    stop = len(rows)
    for i, r in enumerate(rows):
        if not r["own"]:
            continue
        if title >= 0 and abstract < 0 and r["heading"]:
            if r["is_abstract"]:
                abstract = i
            elif r["numbered"] or not r["front_line"]:
                stop = i
                break
        elif title < 0 and r["label"] == "HEADING_LIKE":
            title = i
        elif title >= 0 and r["sentence"]:
            stop = i + 1 if abstract >= 0 and i == abstract + 1 else i
            break
    if title < 0:
        return
    font = rows[title]["font"] or 0.0
    for i, r in enumerate(rows[:stop]):
        if not r["own"]:
            continue
        if i == title:
            role = "title"
        elif abstract >= 0 and i >= abstract:
            role = "abstract-title" if i == abstract else "abstract"
        elif r["date"]:
            role = "date"
        else:
            small = font and (r["font"] if r["font"] is not None else float("inf")) < SMALL_AUTHOR * font
            role = "author" if small or r["author"] else "front"
        yield r["doc"], r["pos"], role


def front_matter(flow: DataFrame) -> DataFrame:
    """doc, pos, role of the first page's title block. flow: doc, pos, text, label, font (largest of its lines, null without lines), of first pages."""
    own = R.strip(F.col("text"))
    words = F.size(F.split(own, f"{R.SPACE}+"))
    rows = flow.select(
        "doc", "pos", "label", "font", (own != "").alias("own"), R.heading(own, F.col("label")).isNotNull().alias("heading"), own.rlike(R.ABSTRACT).alias("is_abstract"), own.rlike(R.NUMBERED).alias("numbered"),
        R.is_front_line(own).alias("front_line"), R.is_body_sentence(own).alias("sentence"), own.rlike(R.DATE_LINE).alias("date"), (own.rlike(R.AUTHOR_LINE) & (words <= 6)).alias("author"),
    )
    return walk(rows, ["doc"], ["pos"], _front_roles, "doc long, pos long, role string")


def confirmed(flow: DataFrame, roles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Roles that metadata (doc, title, author) adds: the first of the first regions that begins with the title, then the first that holds the author, if it had no role of its own."""
    rows = flow.join(roles, ["doc", "pos"], "left").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("n") <= METADATA_FIRST).join(metadata, "doc")
    text, title, author = R.collapse(F.col("text")), R.collapse(F.col("title")), R.collapse(F.col("author"))
    free = F.col("role").isNull() | (F.col("role") == "front")
    first = lambda fits: F.min(F.when(fits, F.col("pos"))).over(Window.partitionBy("doc"))
    rows = rows.withColumn("_t", first(free & (title != "") & F.startswith(text, F.left(title, F.lit(TITLE_MATCH)))))
    rows = rows.withColumn("_a", first(free & (author != "") & text.contains(author) & ~F.col("pos").eqNullSafe(F.col("_t"))))
    return rows.select("doc", "pos", F.when(F.col("pos") == F.col("_t"), "title").when(F.col("pos") == F.col("_a"), "author").alias("role")).where("role IS NOT NULL")


def _equation_runs(rows: list[dict]) -> Iterator[tuple]:
    """Maximal chains of fragments that go on, with their lead-in and number; chains without a formula's label must be clearly mathematics."""
    taken, i, number = -1, 0, 0
    while i < len(rows):
        lead = rows[i]["lead_in"]
        at = i + 1 if lead else i
        if at >= len(rows) or not rows[at]["fragment"]:
            i += 1
            continue
        run = [at]
        while at + 1 < len(rows):
            after = rows[at + 1]
            if after["is_number"] or rows[at]["goes_on"] and after["fragment"]:
                at += 1
                run.append(at)
                if after["is_number"]:
                    break
            else:
                break
        while at + 2 < len(rows) and rows[at + 1]["digits"] and rows[at + 2]["is_number"]:
            at += 1
            run.append(at)
        if at + 1 < len(rows) and rows[at + 1]["is_number"]:
            at += 1
            run.append(at)
        body = [k for k in run if not rows[k]["is_number"]]
        if lead:
            run.insert(0, i)
        elif i > 0 and i - 1 > taken and rows[i - 1]["is_number"]:
            run.insert(0, i - 1)
        text = " ".join(rows[k]["text"] for k in body).strip()
        if not any(rows[k]["label"] == "FORMULA" for k in run) and not strong_math(text):
            i += 1
            continue
        for k in run:
            yield rows[0]["doc"], number, rows[k]["pos"]
        number += 1
        taken, i = at, at + 1


def density(text: str) -> float:
    bare = [c for c in text if not c.isspace()]
    return sum(c in R.MATH_CHARS for c in bare) / len(bare) if bare else 0.0


def strong_math(text: str) -> bool:
    return bool(text) and len(text) <= R.SOLO_MOST and re.search("[=^_]", text) is not None and density(text) >= R.SOLO_SHARE


def equations(flow: DataFrame) -> DataFrame:
    """doc, equation, pos of the regions of displayed equations. flow: doc, pos, text, label, n_lines, goes_on (to the next)."""
    own = R.strip(F.col("text"))
    small = (own != "") & (F.length(own) <= R.DISPLAY_MOST)
    fragment = small & ((F.col("label") == "FORMULA") | (F.col("n_lines") <= FRAGMENT_LINES) & (R.is_display(own) | own.rlike("^(0|[1-9][0-9]?)$")))
    rows = flow.select(
        "doc", "pos", own.alias("text"), "label", F.coalesce("goes_on", F.lit(False)).alias("goes_on"), F.coalesce(fragment, F.lit(False)).alias("fragment"), own.rlike(R.NUMBER_LABEL).alias("is_number"),
        (own.rlike(":$") & (F.length(own) <= LEAD_IN)).alias("lead_in"), own.rlike(r"^\p{Nd}{1,2}$").alias("digits"),
    )
    return walk(rows, ["doc"], ["pos"], _equation_runs, "doc long, equation long, pos long")


def equation_content(members: DataFrame, formulas: DataFrame) -> DataFrame:
    """members: doc, equation, pos, text; formulas: doc, equation, unicode, raw, latex, mathml, number. raw_text without number parts; a candidate's fields come first; the number is that of the last, else the first member."""
    own = R.strip(F.col("text"))
    part = F.when((own != "") & ~own.rlike(R.NUMBER_LABEL), own)
    rows = members.groupBy("doc", "equation").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("pos", part.alias("t"))))), lambda s: s["t"]), " ").alias("_raw"),
        F.coalesce(F.max_by(R.equation_number(F.col("text")), "pos"), F.min_by(R.equation_number(F.col("text")), "pos")).alias("_number"),
    )
    rows = rows.join(formulas, ["doc", "equation"], "left")
    given = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_raw"))
    return rows.select("doc", "equation", given("unicode").alias("unicode_text"), given("raw").alias("raw_text"), "latex", "mathml", F.coalesce("number", "_number").alias("number"))


def bibliography(flow: DataFrame) -> DataFrame:
    """doc, entry, pos of bibliography fragments. flow: doc, pos, text, role (heading, block, caption, equation, paragraph or null).

    Entries stand after the last heading that opens a bibliography, up to the next heading; a labelled text or the first one begins an entry.
    """
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("role") == "heading"
    opens = head & R.strip(F.col("text")).rlike(R.BIBLIOGRAPHY)
    rows = flow.withColumn("_head", F.last(F.when(head, F.col("pos")), ignorenulls=True).over(w)).withColumn("_open", F.last(F.when(head, opens), ignorenulls=True).over(w))
    rows = rows.withColumn("_last", F.max(F.when(opens, F.col("pos"))).over(Window.partitionBy("doc"))).where("_open AND _head = _last AND (role IS NULL OR role = 'paragraph')")
    first = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) == 1
    starts = (F.regexp_extract("text", R.ENTRY_LABEL, 1) != "") | first
    rows = rows.withColumn("_s", starts.cast("int"))
    return rows.select("doc", (F.sum("_s").over(w) - 1).cast("long").alias("entry"), "pos")


def claims(flow: DataFrame, front: DataFrame, captions: DataFrame, equations_: DataFrame, entries: DataFrame) -> DataFrame:
    """doc, pos, role: the first of caption or block, front matter, equation, heading, entry, paragraph that claims a region; an entry wins over a paragraph."""
    flag = lambda rows, name: rows.select("doc", "pos", F.lit(True).alias(name)).distinct()
    rows = flow.join(flag(captions, "_c"), ["doc", "pos"], "left").join(flag(front, "_f"), ["doc", "pos"], "left").join(flag(equations_, "_e"), ["doc", "pos"], "left").join(flag(entries, "_b"), ["doc", "pos"], "left")
    role = (
        F.when(F.col("_c"), "caption").when(F.col("kind").isin("FIGURE", "TABLE", "IMAGE"), "block").when(F.col("_f"), "front").when(F.col("_e"), "equation")
        .when(F.col("level").isNotNull(), "heading").when(F.col("_b"), "entry").otherwise("paragraph")
    )
    return rows.select("doc", "pos", role.alias("role"))


def caption_bindings(members: DataFrame) -> DataFrame:
    """members: grp, group_kind, region, kind. Groups of a figure or table and one text, as caption, main and group_kind."""
    both = members.where("group_kind IN ('FIGURE_BLOCK', 'TABLE_BLOCK')").groupBy("grp", "group_kind").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("kind") == "TEXT", F.col("region"))).alias("caption"), F.max(F.when(F.col("kind").isin("FIGURE", "TABLE"), F.col("region"))).alias("main")
    )
    return both.where("n = 2 AND caption IS NOT NULL AND main IS NOT NULL").select("caption", "main", "group_kind")


def caption_relations(bindings: DataFrame, nodes: DataFrame) -> DataFrame:
    """source and target of CAPTION_OF, where both regions have become nodes (region, node)."""
    a, b = nodes.select(F.col("region").alias("caption"), F.col("node").alias("source")), nodes.select(F.col("region").alias("main"), F.col("node").alias("target"))
    return bindings.join(a, "caption").join(b, "main").select("source", "target").distinct()


def _pieces(rows: list[dict]) -> Iterator[tuple]:
    """Lines of the regions of one group to paragraphs: split inside regions, joined over their borders unless a heading stands there; nothing if no region splits."""
    regions: dict[int, list[list[dict]]] = {}
    for r in rows:
        own = regions.setdefault(r["region"], [])
        if not own or r["starts"]:
            own.append([])
        own[-1].append(r)
    if all(len(p) < 2 for p in regions.values()):
        return
    out: list[list] = []
    for region, parts in regions.items():
        for n, part in enumerate(parts):
            text = ""
            for r in part:
                text = joined(text, r["text"])
            if not text:
                continue
            heading = len(parts) > 1 and len(part) == 1 and part[0]["heading"]
            if n == 0 and out and not out[-1][2] and not heading:
                out[-1][0].append(region)
                out[-1][1] = joined(out[-1][1], text)
            else:
                out.append([[region], text, heading])
    for n, (ids, text, heading) in enumerate(out):
        yield rows[0]["grp"], n, list(dict.fromkeys(ids)), text, heading


def joined(a: str, b: str) -> str:
    """Two texts with a space, or glued where the first ends in a hyphen and the second goes on in lower case."""
    a, b = a.rstrip(), b.lstrip()
    if not a or not b:
        return a or b
    if a.endswith("-") and b[:1].islower():
        return re.sub("-{1,2}$", "", a) + b
    return f"{a} {b}"


def group_pieces(lines: DataFrame) -> DataFrame:
    """lines: grp, seq, region, line_no, text, y, h. Paragraphs of groups of which a region splits: grp, piece, regions, text, heading."""
    w = Window.partitionBy("grp", "region").orderBy("seq")
    clean = R.strip(F.regexp_replace(F.replace("text", F.lit("\x02"), F.lit(" ")), f"{R.SPACE}+", " "))
    head = F.col("_head").isNotNull()
    rows = lines.withColumn("_head", R.heading(F.col("text"), F.lit(None).cast("string"))).withColumn("_ph", F.lag(head).over(w)).withColumn("_pb", F.lag(F.col("y") + F.col("h")).over(w)).withColumn("_pl", F.lag("h").over(w))
    gap = (F.col("y") - F.col("_pb") > 1.5 * F.greatest("_pl", "h", F.lit(1.0))) & (R.strip(F.col("text")) != "")
    rows = rows.select("grp", "seq", "region", clean.alias("text"), head.alias("heading"), F.coalesce(gap | head | F.col("_ph"), F.lit(True)).alias("starts"))
    return walk(rows, ["grp"], ["seq"], _pieces, "grp long, piece long, regions array<long>, text string, heading boolean")


def note_candidates(paragraphs: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """paragraphs: doc, node, text; pages: node, page of its regions; notes: doc, note, label, page. Places where a paragraph on a note's page (or without pages) may refer to it, with scores."""
    rows = paragraphs.select("doc", "node", "text", F.explode(R.spans(F.col("text"), R.BODY_REFERENCE)).alias("s")).select("doc", "node", "text", "s.*")
    number = F.col("match").rlike(r"^\p{Nd}+$")
    rows = rows.where(~(number & F.substring("text", F.col("start").cast("int"), F.lit(1)).rlike(r"\p{Nd}") & (F.col("start") > 0)))
    rows = rows.withColumn("score", R.reference_score(F.col("text"), F.col("start"), F.col("match"))).where("score > 0").drop("text")
    on = pages.groupBy("node").agg(F.collect_set("page").alias("_pages"))
    met = rows.withColumnRenamed("match", "label").join(notes, ["doc", "label"]).join(on, "node", "left").where(F.col("_pages").isNull() | F.array_contains("_pages", F.col("page")))
    return met.select("doc", "note", "label", "page", "node", "start", "stop", "score")


def _assigned(rows: list[dict]) -> Iterator[tuple]:
    """Notes in their order each take the best place that no other has; a near rival makes it ambiguous."""
    claimed: set[tuple] = set()
    notes: dict[tuple, list[dict]] = {}
    for r in rows:
        notes.setdefault((r["page"], r["label"]), []).append(r)
    for (page, label), own in notes.items():
        by_note: dict[int, list[dict]] = {}
        for r in own:
            by_note.setdefault(r["note"], []).append(r)
        if len(by_note) > 1:
            yield rows[0]["doc"], None, None, None, None, None, f"duplicate footnote label {label} on page {page}"
        for note, places in by_note.items():
            able = [r for r in places if r["node"] is not None and r["score"] >= LINK_LEAST and (r["node"], r["start"], r["stop"]) not in claimed]
            if not able:
                yield rows[0]["doc"], note, None, None, None, None, f"unlinked footnote {label} ({note})"
                continue
            best = min(able, key=lambda r: (-r["score"], r["start"]))
            near = {(r["node"], r["start"], r["stop"]) for r in able if best["score"] - r["score"] <= AMBIGUOUS}
            claimed.add((best["node"], best["start"], best["stop"]))
            yield rows[0]["doc"], note, best["node"], best["start"], best["stop"], best["score"], f"ambiguous footnote reference {label} for {note}" if len(near) > 1 else None


def assign_notes(notes: DataFrame, found: DataFrame) -> DataFrame:
    """doc, note, node, start, stop, score and message: one place for each note, or why there is none. notes: doc, note, label, page, pos."""
    rows = notes.join(found.select("note", "node", "start", "stop", "score"), "note", "left")
    first = F.min("pos").over(Window.partitionBy("doc", "page", "label"))
    return walk(rows.withColumn("_f", first), ["doc"], ["_f", "pos", "node", "start"], _assigned, "doc long, note long, node long, start long, stop long, score double, message string")


def citations(nodes: DataFrame) -> DataFrame:
    """nodes: doc, node, text. doc, node, start, stop, key, form: numbers in brackets (ranges filled), and surname:year in parentheses."""
    number = nodes.select("doc", "node", F.explode(R.free_spans(F.col("text"), R.CITATION.replace("(\\p{Nd}{1,3}(?:", "\\p{Nd}{1,3}(?:", 1).replace(")*)\\s*\\]", ")*\\s*\\]", 1))).alias("s"))
    number = number.select("doc", "node", "s.start", "s.stop", F.explode(R.numbers(F.col("s.match"))).alias("key"), F.lit("number").alias("form"))
    plain = R.AUTHOR_YEAR.replace("([A-Z]", "[A-Z]", 1).replace("+)(?:", "+(?:", 1).replace("((?:19|20)", "(?:19|20)", 1).replace("[a-z]?)\\)", "[a-z]?\\)", 1)
    author = nodes.select("doc", "node", F.explode(R.free_spans(F.col("text"), plain)).alias("s"))
    author = author.select("doc", "node", "s.start", "s.stop", R.author_year_key(F.col("s.match")).alias("key"), F.lit("author-year").alias("form"))
    return number.union(author)


def entry_keys(entries: DataFrame) -> DataFrame:
    """doc, key, form, target: what entries (doc, node, pos, text) are cited by; of equal keys the first entry has it."""
    label = entries.select("doc", "node", "pos", F.nullif(F.regexp_extract("text", R.ENTRY_LABEL, 1), F.lit("")).alias("key"), F.lit("number").alias("form"))
    author = entries.select("doc", "node", "pos", R.entry_key(F.col("text")).alias("key"), F.lit("author-year").alias("form"))
    return label.union(author).where("key IS NOT NULL").groupBy("doc", "key", "form").agg(F.min_by("node", "pos").alias("target"))


def resolved(cited: DataFrame, keys: DataFrame) -> DataFrame:
    """cited with target, null where no entry has the key."""
    return cited.join(keys, ["doc", "key", "form"], "left").select("doc", "node", "start", "stop", "key", "form", "target")


def marks(nodes: DataFrame, *sources: DataFrame) -> DataFrame:
    """The marks (node, start, stop, type, target) of paragraphs in order of place and type."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    own = F.array_sort(F.collect_list(F.struct("start", "stop", "type", "target")))
    return nodes.where("kind = 'PARAGRAPH'").select("node").join(every, "node").groupBy("node").agg(own.alias("marks"))


def table_content(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """regions: region, text, lines (array, may be null); cells: region, n_rows, n_columns, n_cells of its evidence. Rows, columns, confidence and reason of each table; without cells each line that is not blank is a row."""
    keep = lambda a: F.filter(F.transform(a, R.strip), lambda x: x != "")
    own = keep(F.coalesce("lines", F.array().cast("array<string>")))
    lines = F.when(F.size(own) > 0, own).otherwise(keep(F.split("text", "\n")))
    rows = regions.join(cells.where("n_cells > 0"), "region", "left")
    known = F.col("n_cells").isNotNull()
    return rows.select(
        "region", F.when(known, F.col("n_rows")).otherwise(F.size(lines)).cast("long").alias("n_rows"), F.when(known, F.col("n_columns")).otherwise(F.least(F.size(lines), F.lit(1))).cast("long").alias("n_columns"),
        F.when(known, CONFIDENCE["TABLE"]).otherwise(CONFIDENCE["TABLE_LINES"]).alias("confidence"), F.when(known, "table structure evidence").otherwise("table fallback: line rows").alias("reason"),
    )


def emitted(claimed: DataFrame) -> DataFrame:
    """claimed: doc, pos, role, kind, group_kind, numbering, level, n_members, continuation, has_label, front_role, has_cells. Kind, confidence, reason and operation of the node each claim becomes."""
    c = CONFIDENCE
    node = lambda kind, score, reason, operation: F.struct(kind.alias("node_kind"), score.cast("double").alias("confidence"), reason.alias("reason"), F.lit(operation).alias("operation"))
    lit, col = F.lit, F.col
    merged = col("n_members") > 1
    as_head = col("front_role").isin("title", "abstract-title")
    made = (
        F.when((col("role") == "front") & as_head, node(lit("HEADING"), lit(c["HEADING"]), F.concat(lit("front matter "), "front_role"), "heading-recovery"))
        .when(col("role") == "front", node(lit("PARAGRAPH"), lit(c["PARAGRAPH"]), F.concat(lit("front matter "), "front_role"), "paragraph-recovery"))
        .when(col("role") == "heading", node(lit("HEADING"), lit(c["HEADING"]), F.when(col("numbering").isNotNull(), "numbered section heading").otherwise("layout heading label"), "heading-recovery"))
        .when(col("role") == "equation", node(lit("EQUATION"), lit(c["EQUATION"]), F.concat(lit("display equation: "), col("n_members").cast("string"), lit(" regions")), "equation-recovery"))
        .when((col("role") == "block") & (col("kind") == "TABLE"), node(lit("TABLE"), F.when(col("has_cells"), c["TABLE"]).otherwise(c["TABLE_LINES"]), F.when(col("has_cells"), "table structure evidence").otherwise("table fallback: line rows"), "table-recovery"))
        .when(col("role") == "block", node(lit("FIGURE"), lit(c["FIGURE"]), lit("layout figure region"), "figure-recovery"))
        .when(col("role") == "caption", node(F.when(col("group_kind") == "TABLE_BLOCK", "TABLE_CAPTION").otherwise("FIGURE_CAPTION"), lit(c["CAPTION"]), lit("layout caption group"), "caption-recovery"))
        .when(col("role") == "entry", node(lit("BIBLIOGRAPHY_ENTRY"), F.when(col("has_label"), c["ENTRY"]).otherwise(c["PARAGRAPH"]), F.when(col("has_label"), "bibliography entry").otherwise("bibliography fragment"), "bibliography-entry"))
        .when(col("role") == "note", node(lit("FOOTNOTE"), lit(c["FOOTNOTE"]), lit("layout footnote region"), "footnote-recovery"))
        .when(merged, node(lit("PARAGRAPH"), F.least(lit(c["MERGED"]), F.coalesce("continuation", lit(0.5))), F.concat(lit("paragraph merge: "), col("n_members").cast("string"), lit(" regions")), "paragraph-merge"))
        .otherwise(node(lit("PARAGRAPH"), lit(c["PARAGRAPH"]), lit("layout text region"), "paragraph-recovery"))
    )
    return claimed.select("doc", "pos", made.alias("n")).select("doc", "pos", "n.*")


def provenance(nodes: DataFrame, node_regions: DataFrame, region_records: DataFrame) -> DataFrame:
    """nodes: doc, node, operation; node_regions: node, pos, region; region_records: region, record. One record a node: its regions, each with its own records, or the document's layout."""
    records = region_records.groupBy("region").agg(F.sort_array(F.collect_list("record")).alias("_r"))
    refs = node_regions.join(records, "region", "left").withColumn("_refs", F.concat(F.array(F.col("region").cast("string")), F.coalesce("_r", F.array().cast("array<string>"))))
    refs = refs.groupBy("node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_refs"))), lambda s: s["_refs"])).alias("_all"))
    key = F.concat_ws("\x1f", F.col("doc").cast("string"), F.lit("sem-prov"), F.lit("node"), F.col("node").cast("string"))
    rows = nodes.join(refs, "node", "left")
    return rows.select("doc", "node", "operation", F.array_join(F.coalesce("_all", F.array(F.concat(F.lit("layout "), F.col("doc").cast("string")))), ",").alias("input_refs"), F.substring(F.sha2(key, 256), 1, 32).alias("record"))


def scholarly(spans: DataFrame) -> DataFrame:
    """spans: doc, page_index, pos, text, font, body_font of the body. doc, name, value: title, author and abstract as the first page has them."""
    own = R.strip(F.col("text"))
    w = Window.partitionBy("doc").orderBy("pos")
    rows = spans.where("page_index = 0").withColumn("own", own).withColumn("n", F.row_number().over(w))
    section = own.rlike(R.SECTION_HEAD)
    for i in range(1, ABSTRACT_LINES + 1):
        rows = rows.withColumn(f"_t{i}", F.lead("own", i).over(w)).withColumn(f"_s{i}", F.coalesce(F.lead(section, i).over(w), F.lit(True)))
    parts = [F.nullif(R.strip(F.regexp_replace("own", r"^\S+", "")), F.lit(""))]
    going = F.lit(True)
    for i in range(1, ABSTRACT_LINES + 1):
        going = going & ~F.col(f"_s{i}")
        parts.append(F.when(going, F.nullif(F.col(f"_t{i}"), F.lit(""))))
    abstract = F.left(F.concat_ws(" ", *parts), F.lit(ABSTRACT_MOST))
    line = R.is_author_line(own, F.col("font"), F.col("body_font")) & F.col("n").between(2, 4)
    found = rows.groupBy("doc").agg(
        F.min_by("own", "n").alias("title"), F.min_by(F.when(line, F.col("own")), F.when(line, F.col("n"))).alias("author"), F.min_by(F.when(own.rlike(R.ABSTRACT_HEAD), abstract), F.when(own.rlike(R.ABSTRACT_HEAD), F.col("n"))).alias("abstract")
    )
    field = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).alias("value"))
    # An empty title is still the first line.
    return found.select("doc", F.explode(F.filter(F.array(field("title"), field("author"), field("abstract")), lambda f: f["value"].isNotNull() & ((f["value"] != "") | (f["name"] == "title")))).alias("f")).select("doc", "f.*")


def inline_windows(text: str) -> list[tuple[int, int]]:
    """Where a text holds short mathematics: tokens around each = ^ _ that are shaped like it, INLINE_MOST characters at most; what overlaps is one."""
    out: list[tuple[int, int]] = []
    for operator in re.finditer("[=^_]", text):
        start, end = operator.span()
        grown = True
        while grown:
            grown = False
            left = re.search(r"(\S+)\s*$", text[:start])
            # A token that the window already cuts into does not count.
            if left and _mathy(text[left.start(1) : start]) and end - left.start(1) <= INLINE_MOST:
                start, grown = left.start(1), True
            right = re.match(r"\s*(\S+)", text[end:])
            if right and _mathy(text[end : end + right.end(1)]) and end + right.end(1) - start <= INLINE_MOST:
                end, grown = end + right.end(1), True
        own = text[start:end].strip()
        if not 3 <= len(own) <= INLINE_MOST or not re.search(r"[\w)\]}]\s*[=^]\s*\w|[=^]\s*[\w(\[{]|\w\^|_\s*\d", re.sub(r"\s+", " ", own)):
            continue
        start = text.index(own, max(start - 1, 0))
        end = start + len(own)
        if re.search("[A-Za-z]{4,}", own) or density(own) < R.DISPLAY_SHARE:
            continue
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _mathy(token: str) -> bool:
    own = token.strip()
    if not own or re.search("[A-Za-z]{4,}", own) or own.isalpha() and len(own) > 1 and not own.isupper():
        return False
    return re.fullmatch(r"[\w()\[\]{}^_+\-*/\\.,−×π]+", own) is not None


def inline_marks(nodes: DataFrame) -> DataFrame:
    """node, start, stop of inline mathematics. nodes: node, text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(n, a, b) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in inline_windows(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["node", "start", "stop"])

    # Only texts with an operator go to Python.
    return nodes.select("node", "text").where(F.col("text").rlike("[=^_]")).mapInArrow(run, "node long, start long, stop long")
