"""Small cases of rules that go row by row: what each must give is told by hand."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import rules as R
from pagemill.operators import flow, fusion, latex, matching, scoring, semantics, structure, translate, tree, viewer, workspace

ITEM = "page long, item long, x double, y double, w double, h double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def box(item, x, y, w=50.0, h=10.0, page=1):
    return (page, item, float(x), float(y), float(w), float(h))


def test_bands_and_columns(spark):
    # A full-width line, two columns, and an equation number that is no column of its own.
    items = [box(1, 0, 0, 400), box(2, 0, 40, 180), box(3, 220, 40, 150), box(4, 375, 40, 20), box(5, 0, 52, 180)]
    df = spark.createDataFrame([(*i, 400.0) for i in items], ITEM + ", page_width double")
    got = {r.item: (r.band, r.col, r.n_columns) for r in structure.bands(df).collect()}
    assert got == {1: (0, 0, 1), 2: (1, 0, 2), 5: (1, 0, 2), 3: (1, 1, 2), 4: (1, 1, 2)}
    df = df.withColumn("doc", F.lit(1)).withColumn("graphic", F.col("item") == 1)
    assert [m for _, m in rows(structure.classified(df, structure.bands(df)), "band", "mode")] == ["SPANNING", "MULTI_COLUMN"]
    plain = df.withColumn("graphic", F.lit(False))
    assert [m for _, m in rows(structure.classified(plain, structure.bands(plain)), "band", "mode")] == ["FULL_WIDTH", "MULTI_COLUMN"]


def test_a_narrow_column_joins_the_left_neighbour_of_two_as_near():
    row = lambda x, w: {"x": x, "y": 0.0, "w": w, "h": 5.0}
    found = structure.columns([row(0.0, 100.0), row(120.0, 10.0), row(150.0, 100.0)], 400.0)
    assert [[r["x"] for r in c] for c in found] == [[0.0, 120.0], [150.0]]
    assert len(structure.columns([row(0.0, 10.0)], 400.0)) == 1


def test_blocks_of_lines(spark):
    text = {1: "A Heading", 2: "first line of the text", 3: "second line", 4: "    indented line", 5: "1. a note", 6: "goes on"}
    at = {1: (0, 0), 2: (0, 40), 3: (0, 52), 4: (15, 64), 5: (0, 100), 6: (0, 111)}
    data = [(*box(i, *at[i], 100), 14.0 if i == 1 else 10.0, text[i], 10.0) for i in text]
    got = {r.item: (r.block, r.label) for r in structure.blocks(spark.createDataFrame(data, ITEM + ", font double, text string, body_font double")).collect()}
    assert got[1] == (0, "HEADING_LIKE") and got[2][0] == got[3][0] and got[4][0] != got[3][0] and got[5][0] == got[6][0] != got[4][0]
    cands = {r.preview: (r.label, r.native) for r in structure.candidates(spark.createDataFrame([(*box(1, 0, 0), 10.0, "Table 3 rows", 10.0), (*box(2, 0, 50), 10.0, "x = y + z", 10.0), (*box(3, 0, 90), 12.0, "Big", 10.0), (*box(4, 0, 130), 10.0, "one", 10.0), (*box(5, 2, 141), 10.0, "two", 10.0)], ITEM + ", font double, text string, body_font double")).collect()}
    assert cands == {"Table 3 rows": ("CAPTION_LIKE", "caption"), "x = y + z": ("FORMULA", "formula"), "Big": ("HEADING_LIKE", "title"), "one two": ("PARAGRAPH_LIKE", "para")}


def test_graphics_merge_until_none_are_near(spark):
    # The third bridges the first two; the rule is thin; the last is far.
    items = [box(1, 0, 0, 10, 10), box(2, 40, 0, 10, 10), box(3, 15, 5, 20, 10), box(4, 0, 100, 200, 1), box(5, 300, 300, 10, 10)]
    assert rows(structure.graphics(spark.createDataFrame(items, ITEM)), "cluster", "n_items", "w") == [(1, 3, 50.0), (5, 1, 10.0)]


def test_notes_go_on(spark):
    data = [(*box(1, 0, 90), "TEXT", "TEXT", "1. note", 8.0), (*box(2, 0, 101), "TEXT", "TEXT", "goes on", 8.0), (*box(3, 0, 112), "TEXT", "TEXT", "and on", 8.0), (*box(4, 200, 101), "TEXT", "TEXT", "aside", 8.0), (*box(5, 0, 10), "TEXT", "TEXT", "2. too high", 8.0)]
    df = spark.createDataFrame(data, ITEM + ", kind string, label string, text string, font double").withColumn("page_height", F.lit(120.0)).withColumn("body_font", F.lit(10.0))
    assert [i for _, i in rows(structure.footnotes(df), "position", "item")] == [1, 2, 3]


def test_fragments_and_cells(spark):
    data = [(1, 1, 0.0, 0.0, 10.0, 10.0, "Hel", 9.0), (1, 2, 10.5, 0.0, 10.0, 10.0, "lo", 10.0), (1, 3, 24.0, 2.0, 10.0, 10.0, "you", 9.0), (1, 4, 60.0, 0.0, 5.0, 10.0, "far", 9.0), (1, 5, 0.0, 30.0, 5.0, 10.0, "low", 9.0)]
    got = rows(structure.merge_fragments(spark.createDataFrame(data, "page long, seq long, x double, y double, w double, h double, text string, font double")), "line", "text", "w", "font")
    assert got == [(0, "Hello you", 34.0, 10.0), (1, "far", 5.0, 9.0), (2, "low", 5.0, 9.0)]
    chars = [(1, i, c, x, 5.0, 10.0) for i, (c, x) in enumerate([("a", 0.0), (" ", 5.0), ("b", 10.0), (" ", 15.0), ("c", 80.0)])]
    assert rows(structure.cells_of_rects(spark.createDataFrame(chars, "rect long, seq long, char string, x double, w double, font double")), "piece", "text") == [(0, "a b"), (1, "c")]


def test_grids_but_no_gutters(spark):
    table = [box(3 * r + c, 100 * c, 20 * r, 40, 10) for r in range(3) for c in range(3)]
    body = [box(20 + 2 * r + c, 102 * c, 20 * r, 100, 10, page=2) for r in range(3) for c in range(2)]
    got = rows(structure.grids(spark.createDataFrame(table + body, ITEM)), "page", "row", "col", "item")
    assert got == [(1, r, c, 3 * r + c) for r in range(3) for c in range(3)]


def test_fusion_of_a_page(spark):
    blocks = spark.createDataFrame([(*box(1, 0, 0, 100, 20), "PARAGRAPH_LIKE", 0.75, "some words here"), (*box(2, 0, 100, 100, 10), "PARAGRAPH_LIKE", 0.75, "row one"), (*box(3, 0, 112, 100, 10), "PARAGRAPH_LIKE", 0.75, "row two")], ITEM + ", label string, confidence double, text string")
    cands = [(11, 1, 0.0, 0.0, 100.0, 20.0, "HEADING_LIKE", "mock", 0.9, "some words here"), (12, 1, 0.0, 98.0, 100.0, 26.0, "TABLE", "docling-sim", 0.8, ""), (13, 1, 0.0, 99.0, 100.0, 20.0, "TEXT", "mock", 0.6, "row one"), (14, 1, 300.0, 300.0, 10.0, 10.0, "FIGURE", "mock", 0.6, ""), (15, 1, 301.0, 300.0, 10.0, 10.0, "FIGURE", "docling-sim", 0.5, "")]
    df = spark.createDataFrame(cands, "candidate long, page long, x double, y double, w double, h double, label string, provider string, confidence double, text string")
    registry = {"layout.region": {"primary": "mock", "challenger": "docling-sim"}, "table.structure": {"primary": "docling-sim"}}
    got = {r.ordinal: (r.kind, sorted(r.objects), sorted(r.evidence), r.labels[0]) for r in fusion.fuse(blocks, df, registry).collect()}
    # The table takes both rows, and the text inside it goes; the heading's vote is the whole of its block's votes.
    assert got == {0: ("TEXT", [1], [11], "HEADING_LIKE"), 1: ("TABLE", [2, 3], [12], "TABLE"), 2: ("FIGURE", [], [14, 15], "FIGURE")}


def test_captions_one_to_one(spark):
    data = [(*box(1, 0, 0, 100, 50), "FIGURE", "FIGURE", "", 0.0), (*box(2, 0, 55, 100, 10), "TEXT", "TEXT", "Figure 1. a", 9.0), (*box(3, 0, 80, 100, 10), "TEXT", "TEXT", "Table 2 b", 9.0), (*box(4, 0, 95, 100, 50), "TABLE", "TABLE", "", 0.0), (*box(5, 0, 67, 100, 10), "TEXT", "TEXT", "no caption", 9.0)]
    df = spark.createDataFrame(data, ITEM.replace("item", "box_id") + ", kind string, label string, text string, font double")
    assert rows(matching.captions(df), "caption", "main") == [(2, 1), (3, 4)]


def test_truth_is_matched_in_its_order_and_ties_go_to_the_later(spark):
    truth = spark.createDataFrame([(1, 0, 0, "TEXT", 0.0, 0.0, 10.0, 10.0), (1, 1, 0, "TEXT", 0.0, 0.0, 10.0, 10.0), (1, 2, 0, "TABLE", 0.0, 0.0, 10.0, 10.0)], "doc long, seq long, page_index long, label string, x double, y double, w double, h double")
    regions = spark.createDataFrame([(1, 7, 0, 0, "TEXT", "TEXT", 0.0, 0.0, 10.0, 10.0), (1, 8, 1, 0, "TEXT", "TEXT", 0.0, 0.0, 10.0, 10.0), (1, 9, 2, 0, "HEADER", "TEXT", 0.0, 0.0, 10.0, 10.0)], "doc long, region long, turn long, page_index long, kind string, label string, x double, y double, w double, h double")
    assert rows(scoring.truth_matches(truth, regions), "seq", "region") == [(0, 8), (1, 7)]
    assert rows(scoring.label_recalls(truth, regions, "TABLE"), "recall") == [(0.0,)]


def test_snippets_take_the_first_free_region(spark):
    s = spark.createDataFrame([(1, 0, "The Ring, is"), (1, 1, "the ring is small"), (1, 2, "...")], "doc long, seq long, text string")
    t = spark.createDataFrame([(1, 5, 0, "the ring-is small and"), (1, 6, 1, "now the ring is SMALL")], "doc long, region long, turn long, text string")
    got = scoring.snippet_matches(s, t)
    assert rows(got, "seq", "region") == [(0, 5), (1, 6)]
    scores = scoring.order_scores(got, spark.createDataFrame([(1, 5, 9), (1, 6, 3)], "doc long, region long, pos long"), s, t).first()
    assert (scores.recall, scores.precision, scores.pairwise, scores.sequence) == (0.6667, 1.0, 0.0, False)


def test_headings_citations_and_notes(spark):
    texts = ["2.1 Methods", "2021.", "2 dx = dy", "References:", "Big Words", "5 apples and pears", "(2) lone", "Introduction"]
    df = spark.createDataFrame([(t, "HEADING_LIKE" if t in ("Big Words", "(2) lone") else None) for t in texts], "t string, label string")
    got = {r.t: r.h and (r.h.level, r.h.numbering) for r in df.select("t", R.heading(F.col("t"), F.col("label")).alias("h")).collect()}
    assert got == {"2.1 Methods": (2, "2.1"), "2021.": None, "2 dx = dy": None, "References:": (1, None), "Big Words": (1, None), "5 apples and pears": (1, "5"), "(2) lone": None, "Introduction": None}
    text = "see [1] and x[2] then [3-4], [9-8][5;6] (Smith & Lee, 2017b) f(Doe 1999)"
    c = semantics.citations(spark.createDataFrame([(1, 1, text)], "doc long, node long, text string"))
    assert [k for _, k in rows(c, "start", "key")] == ["1", "3", "4", "8", "9", "5", "6", "smith:2017b"]
    assert all(text[r.start] in "[(" and text[r.stop - 1] in "])" for r in c.collect())
    spans = spark.createDataFrame([("see note 1, Table 2 and word1. In 2020 too*",)], "t string").select(R.spans(F.col("t"), R.BODY_REFERENCE).alias("s")).first().s
    assert [(s.start, s.match) for s in spans] == [(9, "1"), (18, "2"), (28, "1"), (36, "20"), (42, "*")]


def test_notes_are_assigned_once(spark):
    notes = spark.createDataFrame([(1, 100, "1", 7, 0), (1, 101, "2", 7, 1), (1, 102, "2", 8, 2)], "doc long, note long, label string, page long, pos long")
    paragraphs = spark.createDataFrame([(1, 5, "first word1 and again1 here"), (1, 6, "on Table 2 and a word2.")], "doc long, node long, text string")
    pages = spark.createDataFrame([(5, 7), (6, 7)], "node long, page long")
    found = semantics.note_candidates(paragraphs, pages, notes)
    got = {r.note: (r.node, r.start, r.message) for r in semantics.assign_notes(notes, found).collect()}
    assert got == {100: (5, 10, "ambiguous footnote reference 1 for 100"), 101: (6, 21, None), 102: (None, None, "unlinked footnote 2 (102)")}


def test_front_matter_ends_with_the_abstract(spark):
    text = ["On Small Rings", "Jane Q. Doe", "2021-05-03", "Abstract", "We show that small rings are smaller than they may look.", "1 Introduction", "More."]
    data = [(1, i, t, "HEADING_LIKE" if i == 0 else None, 16.0 if i == 0 else 10.0) for i, t in enumerate(text)]
    got = rows(semantics.front_matter(spark.createDataFrame(data, "doc long, pos long, text string, label string, font double")), "pos", "role")
    assert [r for _, r in got] == ["title", "author", "date", "abstract-title", "abstract"]


def test_equation_runs(spark):
    data = [("A displayed integral:", None, False), ("a = b", None, True), ("+ c", None, False), ("2", None, False), ("(7)", None, False), ("then prose goes on here", None, False), ("x1", None, False), ("(8)", None, False), ("f", "FORMULA", False)]
    df = spark.createDataFrame([(1, i, t, label, 1, g) for i, (t, label, g) in enumerate(data)], "doc long, pos long, text string, label string, n_lines long, goes_on boolean")
    assert rows(semantics.equations(df), "equation", "pos") == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 7), (1, 8)]


def test_inline_mathematics():
    text = "Inline identity f (x ) = x2 appears beside prose. MULTI_COLUMN stays, x_1 counts, and Let a=b"
    assert [text[a:b] for a, b in semantics.inline_windows(text)] == ["f (x ) = x2", "x_1", "a=b"]


def test_paragraphs_split_and_rejoin(spark):
    line = lambda seq, region, text, y: (1, seq, region, text, float(y), 10.0)
    data = [line(0, 1, "one ends in a meth-", 0), line(1, 2, "od and goes on.", 0), line(2, 2, "after a gap", 40), line(3, 2, "2 Results", 50), line(4, 2, "under it", 60)]
    got = semantics.group_pieces(spark.createDataFrame(data, "grp long, seq long, region long, text string, y double, h double"))
    assert [(r.regions, r.text, r.heading) for r in sorted(got.collect(), key=lambda r: r.piece)] == [([1, 2], "one ends in a method and goes on.", False), ([2], "after a gap", False), ([2], "2 Results", True), ([2], "under it", False)]
    whole = spark.createDataFrame(data[:2], "grp long, seq long, region long, text string, y double, h double")
    assert semantics.group_pieces(whole).count() == 0


def test_latex_of_texts_and_tables(spark):
    assert latex.escape("a_b {50%} \\x~^\t\x85") == r"a\_b \{50\%\} \textbackslash{}x\textasciitilde{}\textasciicircum{} "
    said = {"x^2": "x^2", "α≤β": r"\alpha{}\leq{}\beta{}", "√(a+1)": r"\sqrt{a+1}", "√12x": r"\sqrt{12}x", "a=b": "a = b", "x^(n+1)": "x^{n+1}", "E = m…": r"\text{E = m…}", "plain": r"\text{plain}", "√ab": r"\text{√ab}", "y_π": "y_π", "√π": r"\sqrt{π}"}
    assert {t: latex.equation_body(None, t, None) for t in said} == said
    assert latex.equation_body(" z ", "x", None) == "z" and latex.equation_body(None, None, None) == r"\text{}"
    cells = [(1, 2, 3, 0, 0, 1, 2, "a&b"), (1, 2, 3, 0, 2, 2, 1, "t"), (1, 2, 3, 1, 0, 1, 1, "c")]
    got = rows(latex.tabular(spark.createDataFrame(cells, "node long, n_rows int, n_columns int, row int, col int, row_span int, col_span int, text string")), "row", "spec", "line")
    assert got == [(0, "lcc", r"\multicolumn{2}{l}{a\&b} & {\multirow{2}{*}{t}} \\"), (1, "lcc", r"{c} & {} & {} \\")]


def test_latex_is_written(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc long, pos long, latex string")
    latex.write(latex.documents(blocks, "<X>", "X"), str(tmp_path / "tex"))
    assert [p.read_text() for p in (tmp_path / "tex").rglob("part-*")] == ["<a\nb>\n"]
    with pytest.raises(ValueError, match="misses"):
        latex.documents(blocks, "no body", "X")


def test_marks_survive_translation():
    mark = lambda kind, a, b: {"type": kind, "start": a, "stop": b}
    upper = lambda t: "<< " + t.replace("see", "siehe") + " >>"
    out, marks = translate.translated("see [1] now [2]", [mark("CITATION", 4, 7), mark("CITATION", 12, 15), mark("EMPHASIS", 0, 3)], upper)
    assert out == "<< siehe [1] now [2] >>" and [out[m["start"] : m["stop"]] for m in marks] == ["[1]", "[2]"]
    out, marks = translate.translated("abc", [mark("EMPHASIS", 1, 2)], translate.dummy)
    assert (out, marks[0]["start"]) == ("[TRANSLATED] abc", 14)
    for bad in (lambda t: "gone", lambda t: t + t):
        with pytest.raises(RuntimeError, match="placeholders"):
            translate.translated("see [1]", [mark("CITATION", 4, 7)], bad)
    assert translate.merged_spans([(3, 5), (0, 2), (2, 3), (4, 9), (7, 7)]) == [(0, 2), (2, 3), (3, 9)]


def test_contexts_reach_far_enough(spark):
    data = [(1, i, "PARAGRAPH", "ab" * (1 if i % 2 else 40), 1) for i in range(12)]
    texts = [d[3] for d in data]
    for r in translate.contexts(spark.createDataFrame(data, "doc long, pos long, kind string, text string, level long")).collect():
        assert r.before == " ".join(texts[: r.pos])[-240:] and r.after == " ".join(texts[r.pos + 1 :])[:240]
    heads = [(1, 0, "HEADING", "A", 1), (1, 1, "HEADING", "C", 3), (1, 2, "PARAGRAPH", "p", None), (1, 3, "HEADING", "D", 2)]
    got = translate.walk(spark.createDataFrame(heads, "doc long, pos long, kind string, text string, level long"), ["doc"], ["pos"], translate.section_paths, "doc long, pos long, path string")
    assert [p for _, p in rows(got, "pos", "path")] == ["A", "A > C", "A > C", "A > D"]


def test_caches_are_appended_and_the_last_row_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    for text in ("old", "new"):
        translate.append_cache(spark.createDataFrame([("k", text, [], 0.5)], "cacheKey string, text string, marks array<map<string,string>>, confidence double").coalesce(1), path)
    assert rows(translate.read_cache(spark, path), "cache_key", "text") == [("k", "new")]


@pytest.mark.parametrize(("entries", "said"), [([(9, "x")], "unknown node 9"), ([(1, "x"), (1, "y")], "several translations of node 1")])
def test_strange_translations_are_errors(spark, entries, said):
    nodes = spark.createDataFrame([(1, "PARAGRAPH", "t")], "node long, kind string, text string")
    with pytest.raises(Exception, match=said):
        translate.overlay(nodes, spark.createDataFrame(entries, "node long, text string"), spark.createDataFrame([], "caption long, host long")).collect()


def test_glossaries_must_be_arrays(spark):
    with pytest.raises(Exception, match="must be a JSON array"):
        translate.glossary(spark.createDataFrame([(1, "{}")], "file long, json string")).collect()


def test_trees_of_any_depth_and_rings(spark):
    chain = [(i, i - 1 if i else None, i % 3) for i in range(300)]
    nodes = spark.createDataFrame([(str(a), None if b is None else str(b), c) for a, b, c in chain] + [("x", "y", 0), ("y", "x", 0), ("z", "x", 0), ("lost", "nowhere", 0)], "node string, parent string, pos long")
    walked = {r.node: (r.depth, len(r.path)) for r in tree.preorder(nodes, "0").collect()}
    assert walked == {str(i): (i, i + 1) for i in range(300)}
    assert rows(tree.orphans(nodes, "0"), "node") == [("lost",), ("x",), ("y",), ("z",)]
    assert rows(tree.cycles(nodes), "node") == [("x",), ("y",)]
    assert sum(r.below for r in tree.below(nodes, F.col("node") == "250").collect()) == 49


def test_reading_edges(spark):
    base = {"kind": "TEXT", "label": "PARAGRAPH_LIKE", "w": 100.0, "last_w": 100.0, "page": 1, "band": 0, "mode": "MULTI_COLUMN", "col": 0, "col_x": 0.0, "col_w": 100.0, "page_multi": True}
    data = [base | {"region": 1, "text": "it goes on and"}, base | {"region": 2, "text": "ends here.", "col": 1, "col_x": 120.0}, base | {"region": 3, "text": "Wide.", "kind": "FIGURE", "label": "FIGURE", "band": 1, "mode": "SPANNING", "page_multi": True}, base | {"region": 4, "text": "Open text with", "band": 2}, base | {"region": 5, "text": "", "kind": "FIGURE", "label": "FIGURE", "band": 2}, base | {"region": 6, "text": "an end", "band": 2}]
    df = spark.createDataFrame([{**d, "doc": 1, "pos": i} for i, d in enumerate(data)])
    got = rows(flow.edges(df, spark.createDataFrame([(5, 6, 0.7)], "main long, caption long, score double")), "source", "target", "reason", "confidence")
    assert got == [(1, 2, "CONTINUATION", 0.85), (2, 3, "BEFORE_SPANNING_BLOCK", 0.75), (3, 4, "AFTER_SPANNING_BLOCK", 0.75), (4, 5, "SAME_COLUMN", 0.9), (4, 6, "CONTINUATION", 0.85), (5, 6, "CAPTION_ASSOCIATION", 0.7)]


def test_providers_fall_back_once(spark):
    spans = spark.createDataFrame([(1,)], "page long")
    def broken(_):
        raise ValueError("no parser")
    registry = {"table.structure": {"primary": "a", "fallback": "b"}, "layout.region": {"primary": "b"}, "scholarly.metadata": {"primary": "c", "fallback": "a"}}
    done, lost = fusion.collect([("a", ("table.structure", "table.detection")), ("b", ("layout.region",)), ("c", ("scholarly.metadata",))], {"a": broken, "b": lambda s: s, "c": broken}, registry, spans)
    assert list(done) == ["b"] and [(x["provider"], x["substitutes"]) for x in lost] == [("a", ["b"]), ("c", [])]
    with pytest.raises(ValueError, match="schema versions"):
        fusion.bundle([("a", "1", spans), ("b", "1", spans)], ["0.1", "0.2"])


def test_registry_keeps_what_is_internal():
    good = "\n".join(f'[{n}]\nprimary = "internal"' for n in workspace.INTERNAL) + '\n[table.structure]\nprimary = "a"\nfallback = "b"\n'
    assert workspace.registry(good)["table.structure"] == {"primary": "a", "fallback": "b"}
    for bad, said in ((good.replace('fallback = "b"', 'fallback = "a"'), "once"), (good.replace('primary = "internal"', 'primary = "x"', 1), "stay internal"), ('[a.b]\nprimary = "c"', "misses")):
        with pytest.raises(ValueError, match=said):
            workspace.registry(bad)


def test_stages_are_committed_last(spark, tmp_path):
    root = str(tmp_path / "ws")
    for n in (1, 2):
        workspace.commit(spark, spark.range(n), root, "layout", "v1", degraded=n == 2)
    assert workspace.committed(spark, root, "layout").count() == 2 and workspace.committed(spark, root, "render") is None
    assert spark.read.parquet(root + "/manifest").where("status = 'degraded'").count() == 1


def test_sources_documents_and_ids(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert rows(workspace.sources(spark, str(tmp_path)), "fingerprint") == [(hashlib.sha256(b"abc").hexdigest(),)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"id": "x", "n": 3}')
    assert workspace.load_documents(spark, str(tmp_path / "docs"), "id string, n long").first().n == 3
    (tmp_path / "docs" / "b.json").write_text('{"id": "x", "n": "many"}')
    with pytest.raises(Exception):  # noqa: B017
        workspace.load_documents(spark, str(tmp_path / "docs"), "id string, n long").collect()
    ulid = workspace.Ulids()
    made = [ulid(5), ulid(5), ulid(4), ulid(6)]
    assert made == sorted(set(made)) and all(len(u) == 26 for u in made)


def test_pages_outside_are_errors(spark):
    pages = spark.createDataFrame([(1, 0, 70)], "doc long, page_index long, page long")
    assert viewer.pages_at(pages.select("doc", "page_index"), pages).first().page == 70
    with pytest.raises(Exception, match="outside the document"):
        viewer.pages_at(spark.createDataFrame([(1, 4)], "doc long, page_index long"), pages).collect()


def test_boxes_of_dumps(spark):
    from pagemill.sources import adapters

    forms = ['{"x":1,"y":2,"width":3,"height":4}', '{"l":10,"t":90,"r":30,"b":70,"coord_origin":"BOTTOMLEFT"}', '{"l":30,"t":5,"r":10,"b":9}', "[1,2,4,8]", "null"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").select("i", adapters.box(F.parse_json("f"), F.lit(100.0)).alias("b"))
    assert [r.b and tuple(r.b) for r in sorted(df.collect(), key=lambda r: r.i)] == [(1, 2, 3, 4), (10, 10, 20, 20), (10, 5, 20, 4), (1, 2, 3, 6), None]
    for form, height, said in ((forms[1], None, "page's height"), ('{"left":1}', 1.0, "unsupported box"), ("[1,2,3]", 1.0, "unsupported box")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([(form,)], "f string").select(adapters.box(F.parse_json("f"), F.lit(height).cast("double")).alias("b")).collect()


def test_dumps_of_parsers(spark):
    from pagemill.sources import adapters

    dump = '{"tables":[{"page_idx":1,"bbox":[0,0,9,9],"num_rows":"2","table_cells":[{"row":1,"column":"2","row_span":2,"text":"a"},{"start_row_offset_idx":0,"end_row_offset_idx":0,"text":"b"}]},{"prov":[{"page_no":3}],"bbox":[0,0,1,1],"data":{"grid":[[{"text":"x"},null],[{"row":0,"column":0,"text":"again"},{"text":"y","rowSpan":0}]]}}]}'
    df = spark.createDataFrame([(1, dump)], "doc_id long, json string")
    assert rows(adapters.table_cells(df), "tab", "row", "col", "row_span", "text") == [(0, 0, 0, 1, "b"), (0, 1, 2, 2, "a"), (1, 0, 0, 1, "x"), (1, 1, 1, 1, "y")]
    assert rows(adapters.docling_tables(df, 100.0), "tab", "page", "n_rows", "n_columns") == [(0, 1, 2, 3), (1, 2, 2, 2)]
    tei = '<TEI><text><front><div type="abstract"><p>Short.</p></div></front><body><head>1 <hi>Big</hi></head><head/></body><back><persName>Only One</persName><div type="references"/></back></text></TEI>'
    got = adapters.tei_metadata(spark.createDataFrame([(1, tei)], "doc_id long, xml string"))
    assert [(r.name, r.value) for r in got.collect()] == [("author", "Only One"), ("abstract", "Short."), ("head", "1 Big"), ("references", "References")]
    people = '{"title":" T ","authors":["A"," ","B"],"abstract":""}'
    assert rows(adapters.scholarly_metadata(spark.createDataFrame([(1, people)], "doc_id long, json string")), "name", "value") == [("author", "A, B"), ("title", "T")]


def test_a_page_is_scanned(spark):
    from pagemill.sources import scan

    pages = spark.createDataFrame([("s", 0, 200.0, 100.0, 0)], "source string, page int, width double, height double, rotation int")
    rects = spark.createDataFrame([("s", 0, 0, 10.0, 80.0, 30.0, 90.0, "ab c"), ("s", 0, 1, 32.0, 80.0, 42.0, 90.0, "de"), ("s", 0, 2, 0.0, 0.0, 5.0, 5.0, " \n")], "source string, page int, rect int, left double, bottom double, right double, top double, text string")
    chars = [("s", 0, 0, i, c, x, 5.0) for i, (c, x) in enumerate(zip("ab c", (10.0, 15.0, 20.0, 60.0)))] + [("s", 0, 1, i, c, 67.0 + 5 * i, 5.0) for i, c in enumerate("de")]
    chars = spark.createDataFrame(chars, "source string, page int, rect int, seq int, char string, x double, w double")
    objects = [("s", 0, 0, 1, "path", 0.0, 0.0, 9.0, 9.0), ("s", 0, 1, 17, "image", 0.0, 0.0, 9.0, 9.0), ("s", 0, 2, 16, "image", 5.0, 5.0, 9.0, 9.0), ("s", 0, 3, 1, "image", 5.0, 5.0, 5.0, 9.0), ("s", 0, 4, 1, "path", None, None, None, None), ("s", 0, 5, 1, "form", 0.0, 0.0, 9.0, 9.0)]
    objects = spark.createDataFrame(objects, "source string, page int, seq int, depth int, type string, left double, bottom double, right double, top double")
    got = sorted(scan.physical_objects(rects, chars, objects, pages).collect(), key=lambda r: r.position)
    assert [(r.kind, r.n, r.x, r.y, r.w, r.h, r.text, r.font) for r in got] == [("text", 0, 10, 10, 10, 10, "ab", 10), ("text", 1, 60, 10, 17, 10, "c de", 10), ("image", 0, 5, 91, 4, 4, None, None), ("vector", 0, 0, 91, 9, 9, None, None)]
    assert len({r.object for r in got}) == 4


@pytest.mark.parametrize("batch", [7, 10_000])
def test_scans_are_as_the_rules_say(spark, batch):
    """Characters in any order, one by one or in runs, over pages that span batches, against the rules for one rectangle and one page."""
    import random

    from pagemill.sources import scan

    rng = random.Random(5)
    signs = ["a", "b", "é", "中", "😀", " ", " ", "\t", "\u3000"]
    rects, chars, runs, objects, pages, expected = [], [], [], [], [], set()
    for source, page in ((s, p) for s in ("s", "t") for p in range(30)):
        known = (source, page) != ("t", 3)
        fragments, at, own = [], 0.0, []
        for rect in range(rng.choice([0, 1, 6])):
            bottom, font, blank = rng.choice([0.0, 0.0, 4.0, 40.0]), rng.choice([0.25, 10.0, 10.0, -2.0]), rng.random() < 0.15
            rects.append((source, page, rect, at, bottom, at + 9, bottom + font, " \n" if blank else "x"))
            cells, x = [], at
            for seq in range(rng.choice([0, 1, 30])):
                x += rng.choice([0.0, 1.0, 1.0, 3.0, 3.25, 8.0, 30.0, 30.25, -4.0, -40.0])
                cells.append({"rect": rect, "seq": seq, "char": rng.choice(signs), "x": x, "w": rng.choice([1.0, 5.0, 50.0]), "font": font})
            # What a rectangle lacks keeps its numbers, so that runs end there.
            cells = [c for c in cells if rng.random() < 0.95]
            chars += [(source, page, rect, c["seq"], c["char"], c["x"], c["w"]) for c in cells]
            pieces = list(scan.S.split_cells(cells)) if cells and not blank else []
            fragments += [{"page": page, "x": x, "y": bottom, "w": w, "h": font, "text": t, "font": font} for _, _, x, w, t in pieces]
            if pieces:
                at = pieces[-1][2] + pieces[-1][3] + rng.choice([0.5, 2.0, 6.0, 6.25, -1.0])
        for seq in range(rng.choice([0, 1, 12])):
            kind = rng.choice(["image", "path", "form"])
            objects.append((source, page, seq, 1, kind, float(seq), 1.0, seq + 2.0, 3.0))
            own += [("image" if kind == "image" else "vector", seq)] if kind != "form" else []
        if known:
            pages.append((source, page, 100.0, 200.0, 0))
            lines = [("text", n, t, x, w, 200.0 - y - h, h, round(f, 2) or None) for _, n, x, y, w, h, t, f in (scan.S.merged_fragments(fragments) if fragments else ())]
            for kind in ("image", "vector"):
                lines += [(kind, n, None, float(seq), 2.0, 197.0, 2.0, None) for n, seq in enumerate(q for k, q in own if k == kind)]
            # Boxes as shown have no negative height.
            expected |= {(source, page, i + 1, *r[:5], min(r[5], r[5] + r[6]), abs(r[6]), r[7]) for i, r in enumerate(lines)}
    for c in chars:
        last = runs[-1] if runs else None
        if last and last[:3] == c[:3] and c[3] == last[3] + len(last[4]) and rng.random() < 0.8:
            runs[-1] = (*last[:4], last[4] + c[4], last[5] + [c[5]], last[6] + [c[6]])
        else:
            runs.append((*c[:5], [c[5]], [c[6]]))
    rng.shuffle(runs)
    single = list(chars)
    half = len(single) // 2
    tail = single[half:]
    rng.shuffle(tail)
    single[half:] = tail
    make = spark.createDataFrame
    key = "source string, page long, rect long"
    pages = make(pages, "source string, page long, width double, height double, rotation int")
    rects = make(rects, f"{key}, left double, bottom double, right double, top double, text string")
    objects = make(objects, "source string, page long, seq long, depth int, type string, left double, bottom double, right double, top double")
    forms = [make(single, f"{key}, seq int, char string, x double, w double"), make(runs, f"{key}, seq long, char string, x array<double>, w array<double>")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for form in forms:
            got = scan.physical_objects(rects, form, objects, pages).collect()
            assert {(r.source, r.page, r.position, r.kind, r.n, r.text, r.x, r.w, r.y, r.h, r.font) for r in got} == expected and len(got) == len(expected)
            assert sum(r.kind == "text" and "  " not in r.text and " " in r.text for r in got) > 20
            nothing = scan.physical_objects(rects, form.limit(0), objects.limit(0), pages)
            assert nothing.count() == 0 and scan.physical_objects(rects, form, objects, pages.limit(0)).count() == 0
            assert scan.text_spans(rects, form, pages).count() == sum(r.kind == "text" for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(Exception, match="without a place"):
        scan.physical_objects(rects, forms[0].withColumn("x", F.lit(None).cast("double")), objects, pages).collect()


def test_characters_are_not_dealt_out(spark):
    """Lines, boxes and pages are dealt out by page once; what is made of them, characters above all, never."""
    import __spark_entry__ as entry

    plan = entry.queries()["physical_objects"](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert all("hashpartitioning(l_orderkey" in line or "hashpartitioning(page" in line for line in dealt) and len(dealt) == 4 and "Join" not in plan, dealt


def test_revisions(spark, tmp_path):
    from pagemill.operators import workspace as K

    root, rows = str(tmp_path), lambda n: {"nodes": spark.range(n)}
    assert K.revision(spark, root) is None and K.publish(spark, rows(1), root, None) == 1 and K.publish(spark, rows(2), root, 1) == 2
    for stale in (None, 1, 3):
        with pytest.raises(ValueError):
            K.publish(spark, rows(9), root, stale)
    with pytest.raises(Exception):
        K.publish(spark, {"nodes": spark.range(3), "bad": spark.range(1).select(F.raise_error(F.lit("no")))}, root, 2)
    assert K.revision(spark, root) == 2 and K.published(spark, root, "nodes").count() == 2 and K.published(spark, root, "nodes", 1).count() == 1


def test_sizes_of_tables_are_not_broadcast(spark, tmp_path):
    from pagemill.sources import adapters

    spark.createDataFrame([(1, '{"tables":[{"data":{"num_rows":2,"num_cols":1}}]}')], "doc_id long, json string").write.parquet(f"{tmp_path}/dumps")
    df = spark.read.parquet(f"{tmp_path}/dumps")
    assert "BroadcastHashJoin" not in adapters.docling_tables(df, 100.0)._jdf.queryExecution().executedPlan().toString()
