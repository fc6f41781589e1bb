"""Recovered documents against truth: matches, order, coverage, reports, comparison with a baseline."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .walk import walk

# Overlap of a match, furniture that is no region, words of a snippet that must be found, and the tolerance of comparisons.
IOU, FURNITURE, PROBE, TOLERANCE = 0.5, ("HEADER", "FOOTER"), 6, 0.001
ANCHORED = ("PARAGRAPH", "HEADING", "FIGURE", "TABLE", "EQUATION", "FOOTNOTE", "BIBLIOGRAPHY_ENTRY")


def truth_rows(files: DataFrame) -> DataFrame:
    """files: doc, json (an array of regions). Rows with a whole geometry; others are skipped. seq keeps their order."""
    schema = "array<struct<pageIndex:bigint,label:string,textPreview:string,geometry:struct<x:double,y:double,width:double,height:double>>>"
    rows = files.select("doc", F.posexplode(F.from_json("json", schema)).alias("seq", "r"))
    whole = F.col("r.geometry.x").isNotNull() & F.col("r.geometry.y").isNotNull() & F.col("r.geometry.width").isNotNull() & F.col("r.geometry.height").isNotNull()
    return rows.where(whole).select(
        "doc", F.col("seq").cast("long").alias("seq"), F.coalesce("r.pageIndex", F.lit(0)).alias("page_index"), F.coalesce("r.label", F.lit("UNKNOWN")).alias("label"), F.col("r.geometry.x").alias("x"), F.col("r.geometry.y").alias("y"),
        F.col("r.geometry.width").alias("w"), F.col("r.geometry.height").alias("h"), F.coalesce("r.textPreview", F.lit("")).alias("preview"),
    )


def _in_order(rows: list[dict]) -> Iterator[tuple]:
    """Truth rows in their order each take the best region that is left; of equal ones the later."""
    used: set[int] = set()
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["seq"] == rows[at]["seq"]:
            end += 1
        best = max((r for r in rows[at:end] if r["region"] not in used), key=lambda r: (r["iou"], r["turn"]), default=None)
        if best:
            used.add(best["region"])
            yield best["doc"], best["seq"], best["region"], best["iou"]
        at = end


def truth_matches(truth: DataFrame, regions: DataFrame) -> DataFrame:
    """truth: doc, seq, page_index, label, x, y, w, h; regions: doc, region, turn, page_index, kind, label, x, y, w, h. doc, seq, region, iou: one to one, on one page, of one label, at IOU or more."""
    a = truth.select("doc", "seq", "page_index", "label", *(F.col(c).alias(f"a_{c}") for c in "xywh"))
    b = regions.where(~F.col("kind").isin(*FURNITURE)).select("doc", "region", "turn", "page_index", "label", *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    able = a.join(b, ["doc", "page_index", "label"]).withColumn("iou", G.iou("b_", "a_")).where(F.col("iou") >= IOU)
    return walk(able.select("doc", "seq", "region", "turn", "iou"), ["doc"], ["seq", "turn"], _in_order, "doc long, seq long, region long, iou double")


def _first_free(rows: list[dict]) -> Iterator[tuple]:
    used: set[int] = set()
    done: set[int] = set()
    for r in rows:
        if r["seq"] not in done and r["region"] not in used:
            done.add(r["seq"])
            used.add(r["region"])
            yield r["doc"], r["seq"], r["region"]


def snippet_matches(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    """snippets: doc, seq, text; texts: doc, region, turn, text. Each snippet's first words in the first region, in order, that no other has."""
    probe = F.array_join(F.slice(T.ascii_tokens(F.col("text")), 1, PROBE), " ")
    a = snippets.select("doc", "seq", probe.alias("probe")).where("probe <> ''")
    b = texts.select("doc", "region", "turn", F.array_join(T.ascii_tokens(F.col("text")), " ").alias("words")).where("words <> ''")
    able = a.join(b, "doc").where(F.instr("words", F.col("probe")) > 0)
    return walk(able.select("doc", "seq", "region", "turn"), ["doc"], ["seq", "turn"], _first_free, "doc long, seq long, region long")


def order_scores(matches: DataFrame, flow: DataFrame, truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row a document of truth (doc, seq): recall, precision, share of pairs in order, and whether all are. matches: doc, seq, region; flow: doc, region, pos; recovered: doc, region counts for precision."""
    placed = matches.join(flow, ["doc", "region"])
    a, b = placed.select("doc", F.col("seq").alias("s"), F.col("pos").alias("p")), placed.select("doc", F.col("seq").alias("t"), F.col("pos").alias("q"))
    right = F.col("p") < F.col("q")
    pairs = a.join(b, "doc").where("s < t").groupBy("doc").agg(F.avg(right.cast("int")).alias("_pairs"), F.bool_and(F.col("p") <= F.col("q")).alias("_exact"))
    count = lambda t, name: t.groupBy("doc").agg(F.count("*").alias(name))
    rows = count(truth, "n_truth").join(count(matches, "_m"), "doc", "left").join(count(recovered, "_r"), "doc", "left").join(pairs, "doc", "left")
    share = lambda n, of: F.round(F.when(F.coalesce(of, F.lit(0)) > 0, F.coalesce(n, F.lit(0)) / of).otherwise(1.0), 4)
    return rows.select("doc", share(F.col("_m"), F.col("n_truth")).alias("recall"), share(F.col("_m"), F.col("_r")).alias("precision"), F.round(F.coalesce("_pairs", F.lit(1.0)), 4).alias("pairwise"), F.coalesce("_exact", F.lit(True)).alias("sequence"))


def label_recalls(truth: DataFrame, regions: DataFrame, label: str) -> DataFrame:
    """doc, recall of the truth of one label, matched by itself; no row without any."""
    own = truth.where(F.col("label") == label)
    met = truth_matches(own, regions).groupBy("doc").agg(F.count("*").alias("_m"))
    return own.groupBy("doc").agg(F.count("*").alias("_n")).join(met, "doc", "left").select("doc", F.round(F.coalesce("_m", F.lit(0)) / F.col("_n"), 4).alias("recall"))


def text_coverage(documents: DataFrame, spans: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, coverage: characters of regions over those extracted, at most 1; 1 where nothing was."""
    total = spans.groupBy("doc").agg(F.sum(F.length("text")).alias("_t"))
    own = regions.groupBy("doc").agg(F.sum(F.length("text")).alias("_c"))
    rows = documents.select("doc").distinct().join(total, "doc", "left").join(own, "doc", "left")
    return rows.select("doc", F.when(F.coalesce("_t", F.lit(0)) > 0, F.round(F.least(F.coalesce("_c", F.lit(0)) / F.col("_t"), F.lit(1.0)), 4)).otherwise(1.0).alias("coverage"))


def _share(flag: Column, of: Column) -> Column:
    """An aggregate: the share of the rows `of` that have the flag, 1 without such rows."""
    n = F.count(F.when(of, 1))
    return F.when(n > 0, F.round(F.count(F.when(of & flag, 1)) / n, 4)).otherwise(1.0)


def node_coverages(nodes: DataFrame) -> DataFrame:
    """nodes: doc, kind, bound, rendered, n_columns. Shares of anchored kinds with source regions and with rendered fragments, and of tables with several columns."""
    anchored = F.col("kind").isin(*ANCHORED)
    return nodes.groupBy("doc").agg(
        _share(F.coalesce("bound", F.lit(False)), anchored).alias("source_mapping"), _share(F.coalesce("rendered", F.lit(False)), anchored).alias("render_mapping"),
        _share(F.coalesce(F.col("n_columns") > 1, F.lit(False)), F.col("kind") == "TABLE").alias("table_structure"),
    )


def citation_rates(documents: DataFrame, marks: DataFrame, unresolved: DataFrame) -> DataFrame:
    """doc, rate: 1 less unresolved issues for each citation mark, 0 at least; 1 without marks."""
    m = marks.groupBy("doc").agg(F.count("*").alias("_m"))
    u = unresolved.groupBy("doc").agg(F.count("*").alias("_u"))
    rows = documents.select("doc").distinct().join(m, "doc", "left").join(u, "doc", "left")
    return rows.select("doc", F.when(F.col("_m") > 0, F.round(F.greatest(1 - F.coalesce("_u", F.lit(0)) / F.col("_m"), F.lit(0.0)), 4)).otherwise(1.0).alias("rate"))


def expectations(documents: DataFrame, nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: doc, kind, least (1 for mere presence). doc, score: the share of expectations that hold; 1 without any."""
    counts = nodes.groupBy("doc", "kind").agg(F.count("*").alias("_n"))
    held = expected.join(counts, ["doc", "kind"], "left").groupBy("doc").agg(F.avg((F.coalesce("_n", F.lit(0)) >= F.col("least")).cast("int")).alias("_s"))
    return documents.select("doc").distinct().join(held, "doc", "left").select("doc", F.round(F.coalesce("_s", F.lit(1.0)), 4).alias("score"))


def report(documents: DataFrame, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row a document with a measure of each part (table, column); null where a part has no row for it."""
    out = documents.select("doc").distinct()
    for name, (rows, column) in parts.items():
        out = out.join(rows.select("doc", F.col(column).alias(name)), "doc", "left")
    return out


def seed_truth(regions: DataFrame, matched: DataFrame) -> DataFrame:
    """regions: doc, region, page_index, kind, label, x, y, w, h, text. Matched regions, and all figures, tables and formulas, as truth to be reviewed."""
    kept = regions.join(matched.select("region").distinct().withColumn("_m", F.lit(True)), "region", "left")
    kept = kept.where((F.col("_m") | F.col("kind").isin("FIGURE", "TABLE", "FORMULA")) & ~F.col("kind").isin(*FURNITURE))
    return kept.select("doc", "region", "page_index", "label", *(F.round(c, 2).alias(c) for c in "xywh"), F.left(F.coalesce("text", F.lit("")), F.lit(80)).alias("preview"))


def compared(base: DataFrame, now: DataFrame) -> DataFrame:
    """base and now: fixture, metric, value. A verdict for each metric, and one for each fixture that is gone; counts of blocking issues (metric `blocking`) may not rise, other metrics not fall."""
    gone = base.select("fixture").distinct().join(now.select("fixture").distinct(), "fixture", "left_anti")
    rows = base.withColumnRenamed("value", "b").join(now.withColumnRenamed("value", "n"), ["fixture", "metric"], "full_outer").join(gone, "fixture", "left_anti")
    up = F.when(F.col("metric") == "blocking", F.col("b") - F.col("n")).otherwise(F.col("n") - F.col("b"))
    least = F.when(F.col("metric") == "blocking", 0.0).otherwise(TOLERANCE)
    verdict = F.when(F.col("b").isNotNull() & F.col("n").isNull(), "REGRESSED").when(F.col("b").isNull() & F.col("n").isNull(), "unchanged").when(F.col("b").isNull() | (up > least), "improved").when(up < -least, "REGRESSED").otherwise("unchanged")
    return rows.select("fixture", "metric", verdict.alias("verdict")).union(gone.select("fixture", F.lit("missing"), F.lit("REGRESSED")))


def schema_errors(value, schema: dict, root: dict, at: str = "") -> list[tuple[str, str]]:
    """(pointer, message) of what a JSON value breaks of a schema: $ref, oneOf, type, const, enum, required, properties, additionalProperties, items, minimum, maximum, minLength."""
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        return schema_errors(value, target, root, at)
    if "oneOf" in schema:
        fits = sum(not schema_errors(value, s, root, at) for s in schema["oneOf"])
        return [] if fits == 1 else [(at, f"matches {fits} of the alternatives")]
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    number = isinstance(value, int | float) and not isinstance(value, bool)
    kind = schema.get("type")
    if kind:
        fits = number and (kind == "number" or float(value).is_integer()) if kind in ("number", "integer") else isinstance(value, kinds[kind])
        if not fits:
            return [(at, f"is not of type {kind}")]
    out = []
    if "const" in schema and value != schema["const"]:
        out.append((at, "is not the constant"))
    if "enum" in schema and value not in schema["enum"]:
        out.append((at, "is not among the values"))
    if number and value < schema.get("minimum", value) or number and value > schema.get("maximum", value):
        out.append((at, "is out of range"))
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append((at, "is too short"))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [(f"{at}/{k}", "is missing") for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], root, f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{at}/{k}", "is not allowed"))
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], root, f"{at}/{i}")
    return out


def validated(rows: DataFrame, schema: dict) -> DataFrame:
    """rows: id, json. id, pointer, message of what each JSON text breaks; a text that is no JSON breaks at its root."""

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    out.append((i, "", "is not JSON"))
                    continue
                out += [(i, p, m) for p, m in schema_errors(value, schema, schema)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["id", "pointer", "message"])

    return rows.select("id", "json").mapInArrow(run, "id long, pointer string, message string")


def ordinal(by: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
