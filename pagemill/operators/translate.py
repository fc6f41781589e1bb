"""Translation of nodes: protected marks, requests with context, caches, merges of layers, glossaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .walk import walk

# Kinds that are translated, marks that must survive, the sign of the provider that only marks, the version of caches, and characters of context.
TEXT_KINDS = ("HEADING", "PARAGRAPH", "FIGURE_CAPTION", "TABLE_CAPTION", "FOOTNOTE")
PROTECTED = ("CITATION", "FIGURE_REFERENCE", "TABLE_REFERENCE", "EQUATION_REFERENCE", "SECTION_REFERENCE", "INLINE_EQUATION", "FOOTNOTE_REFERENCE", "LINK")
MARKER, DUMMY, CACHE_VERSION, CONTEXT = "[TRANSLATED]", "dummy", "1", 240


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap are one, those that touch are not."""
    out: list[tuple[int, int]] = []
    for start, end in sorted({s for s in spans if s[1] > s[0]}):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def translated(text: str, marks: list[dict], translate: Callable[[str], str]) -> tuple[str, list[dict]]:
    """The translation of a text and its marks where they then stand.

    Protected marks become tokens that the text does not hold; the translation must hold each of them once. Without such marks
    a translation that is the text after a prefix shifts all; any other protects every mark.
    """
    if not marks:
        return translate(text), []
    kept = [m for m in marks if m["type"] in PROTECTED]
    if not kept:
        out = translate(text)
        if out.endswith(text):
            by = len(out) - len(text)
            return out, [m | {"start": m["start"] + by, "stop": m["stop"] + by} for m in marks if 0 <= m["start"] + by < m["stop"] + by <= len(out)]
        kept = marks
    spans = merged_spans([(m["start"], m["stop"]) for m in kept])
    nonce = next(n for n in range(10_000) if f"⟦{n}:" not in text)
    pieces, at = [], 0
    for i, (start, end) in enumerate(spans):
        pieces += [text[at:start], f"⟦{nonce}:{i}⟧"]
        at = end
    out = translate("".join([*pieces, text[at:]]))
    parts = re.split(rf"⟦{nonce}:(\d+)⟧", out)
    found = [int(i) for i in parts[1::2]]
    if sorted(found) != list(range(len(spans))):
        raise RuntimeError(f"translation altered protected placeholders: {sorted(found)} for {len(spans)}")
    result, place = parts[0], {}
    for i, rest in zip(found, parts[2::2], strict=True):
        place[i] = len(result)
        result += text[spans[i][0] : spans[i][1]] + rest
    moved = []
    for m in kept:
        i = next((i for i, (a, b) in enumerate(spans) if a <= m["start"] and m["stop"] <= b), None)
        if i is not None:
            by = place[i] - spans[i][0]
            moved.append(m | {"start": m["start"] + by, "stop": m["stop"] + by})
    return result, moved


def dummy(text: str) -> str:
    return f"{MARKER} {text}"


RICH = "node long, text string, marks array<struct<type:string,start:long,stop:long,target:long>>"


def translate_rich(nodes: DataFrame, translate: Callable[[str], str] = dummy) -> DataFrame:
    """nodes: node, text, marks. The same, translated, by a function that workers can call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [translated(t, m or [], translate) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([m for _, m in rows], batch.column(2).type)], names=["node", "text", "marks"])

    return nodes.select("node", "text", "marks").mapInArrow(run, RICH)


def section_paths(rows: list[dict]) -> Iterator[tuple]:
    """Headings above each node: a heading of level n closes the titles from the n-th on."""
    titles: list[str] = []
    for r in rows:
        if r["kind"] == "HEADING" and r["text"]:
            del titles[max(r["level"] or 1, 1) - 1 :]
            titles.append(r["text"])
        yield r["doc"], r["pos"], " > ".join(titles)


def contexts(nodes: DataFrame) -> DataFrame:
    """nodes: doc, pos, kind, text, level in tree order. before and after (CONTEXT characters of neighbouring texts that are translated) and section path of each.

    A text is a character at least, so as many rows as characters hold a context; longer texts count with their near end.
    """
    own = R.strip(F.col("text"))
    rows = nodes.where(F.col("kind").isin(*TEXT_KINDS) & (own != "")).select("doc", "pos", F.right(own, F.lit(CONTEXT)).alias("_tail"), F.left(own, F.lit(CONTEXT)).alias("_head"))
    w = Window.partitionBy("doc").orderBy("pos")
    tails, heads = F.collect_list("_tail").over(w.rowsBetween(-CONTEXT, -1)), F.collect_list("_head").over(w.rowsBetween(1, CONTEXT))
    near = rows.select("doc", "pos", F.right(F.array_join(tails, " "), F.lit(CONTEXT)).alias("before"), F.left(F.array_join(heads, " "), F.lit(CONTEXT)).alias("after"))
    paths = walk(nodes.select("doc", "pos", "kind", "text", "level"), ["doc"], ["pos"], section_paths, "doc long, pos long, section_path string")
    return near.join(paths, ["doc", "pos"])


def digest(*parts: Column) -> Column:
    """Sixteen hex digits of named key material as JSON with sorted keys."""
    return F.left(F.sha2(F.to_json(F.struct(*parts)), 256), F.lit(16))


def cache_key(node: Column, content: Column, context: Column, target: str, model: str, terminology: Column, kind: Column) -> Column:
    fields = {"content": digest(content.alias("content")), "context": context, "kind": kind, "model": F.lit(model), "node": node, "target": F.lit(target), "terminology": terminology, "version": F.lit(CACHE_VERSION)}
    return digest(*[fields[k].alias(k) for k in sorted(fields)])


def translate_document(nodes: DataFrame, cells: DataFrame, cache: DataFrame, target: str = "und-x-dummy", model: str = DUMMY) -> DataFrame:
    """node, cell, pos, text, cached, cache_key of every translated text and table cell, in node order; others stay as they are.

    nodes: node, pos, kind, text, context, terminology; cells: node, cell, text; cache: cache_key, cached_text. A cached text is taken as it is.
    """
    text = nodes.where(F.col("kind").isin(*TEXT_KINDS)).select("node", F.lit(None).cast("long").alias("cell"), "pos", "kind", "text", "context", "terminology")
    of_tables = cells.join(nodes.where("kind = 'TABLE'").select("node", "pos", "kind", "context", "terminology"), "node").select("node", "cell", "pos", "kind", "text", "context", "terminology")
    rows = text.union(of_tables)
    rows = rows.withColumn("cache_key", cache_key(F.col("node"), F.col("text"), F.col("context"), target, model, F.col("terminology"), F.col("kind")))
    met = rows.join(cache, "cache_key", "left")
    new = F.coalesce("cached_text", F.concat(F.lit(f"{MARKER} "), "text"))
    return met.select("node", "cell", "pos", new.alias("text"), F.col("cached_text").isNotNull().alias("cached"), "cache_key")


def upsert(old: DataFrame, refreshed: DataFrame) -> DataFrame:
    """old: node, pos, content, model; refreshed: node, content, model. Entries with what is new in their old places, new nodes behind."""
    last = old.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_last"))
    both = old.join(refreshed.select("node", F.col("content").alias("_c"), F.col("model").alias("_m")), "node", "full_outer").crossJoin(F.broadcast(last))  # one row
    return both.select("node", F.coalesce("pos", F.col("_last") + 1 + F.col("node")).alias("pos"), F.coalesce("_c", "content").alias("content"), F.coalesce("_m", "model").alias("model"))


def layer_model(entries: DataFrame, by: str, latest: Column) -> DataFrame:
    """The one model of a layer's entries, or that of the latest pass."""
    own = F.nullif("model", F.lit(""))
    return entries.groupBy(by).agg(F.when(F.countDistinct(own) == 1, F.max(own)).otherwise(F.max(latest)).alias("model"))


def needs_provider(layers: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """by, needs: whether a layer or any of its entries was made by another model than the dummy."""
    real = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & (F.trim(F.coalesce(c, F.lit(""))) != DUMMY)
    own = entries.groupBy(by).agg(F.bool_or(real(F.col("model"))).alias("_e"))
    return layers.join(own, by, "left").select(by, (real(F.col("layer_model")) | F.coalesce("_e", F.lit(False))).alias("needs"))


def overlay(nodes: DataFrame, entries: DataFrame, captions: DataFrame) -> DataFrame:
    """nodes: node, kind, text; entries: node, text; captions: caption, host. Content of each node, translated where it is, with that of its caption; captions of figures and tables are not rows of their own.

    Entries for unknown nodes, and several for one, are errors.
    """
    counted = entries.groupBy("node").agg(F.count("*").alias("_n"), F.first("text").alias("_text"))
    known = nodes.select("node", "kind", "text").join(counted, "node", "full_outer")
    guard = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("translation of unknown node "), F.col("node").cast("string"))).cast("string")).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several translations of node "), F.col("node").cast("string"))).cast("string"))
    shown = known.select("node", F.coalesce(guard, F.col("kind")).alias("kind"), F.coalesce("_text", "text").alias("content"))
    hosts = shown.where("kind IN ('FIGURE', 'TABLE')").select(F.col("node").alias("host"))
    bound = captions.join(hosts, "host").select("caption", "host")
    of_host = bound.join(shown.select(F.col("node").alias("caption"), F.col("content").alias("caption_text")), "caption").groupBy("host").agg(F.max_by(F.struct("caption", "caption_text"), "caption").alias("c"))
    rows = shown.join(bound.select(F.col("caption").alias("node")), "node", "left_anti")
    return rows.join(of_host.withColumnRenamed("host", "node"), "node", "left").select("node", "kind", "content", F.col("c.caption").alias("caption"), F.col("c.caption_text").alias("caption_text"))


def cache_rows(lines: DataFrame) -> DataFrame:
    """lines: seq, line (JSON). Rows of this cache version by key, the last of each; mark properties that are null count as not set."""
    schema = "cacheVersion string, cacheKey string, text string, confidence double, marks array<map<string,string>>"
    rows = lines.where(F.trim("line") != "").select("seq", F.from_json("line", schema).alias("r")).where(F.col("r.cacheVersion") == CACHE_VERSION)
    last = rows.groupBy(F.col("r.cacheKey").alias("cache_key")).agg(F.max_by("r", "seq").alias("r"))
    set_only = F.transform(F.coalesce("r.marks", F.array().cast("array<map<string,string>>")), lambda m: F.map_filter(m, lambda _, v: v.isNotNull()))
    return last.select("cache_key", F.col("r.text").alias("text"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), set_only.alias("marks"))


def append_cache(rows: DataFrame, path: str) -> None:
    """Appends rows (cacheKey, text, marks, confidence) to a folder of JSON lines."""
    rows.withColumn("cacheVersion", F.lit(CACHE_VERSION)).write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache of a folder; of a key written twice the row of the later file counts."""
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("seq"), F.col("value").alias("line"))
    return cache_rows(lines)


def glossary(files: DataFrame) -> DataFrame:
    """files: file, json. term and preferred of each entry that has both as texts; a file that is no array is an error."""
    v = F.parse_json("json")
    ok = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    said = F.raise_error(F.concat(F.lit("terminology must be a JSON array: "), F.col("file").cast("string"))).cast("array<variant>")
    rows = files.select("file", F.posexplode(F.when(ok, F.from_json("json", "array<variant>")).otherwise(said)).alias("pos", "v"))
    text = lambda path: F.try_variant_get("v", path, "string")
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.lit(False))
    return rows.where(is_text("$.term") & is_text("$.preferredTranslation")).select("file", "pos", text("$.term").alias("term"), text("$.preferredTranslation").alias("preferred"))


def merged_glossary(manual: DataFrame, derived: DataFrame) -> DataFrame:
    """doc, term, preferred, source: manual terms (of equal ones the last), and derived ones of other names, with the revision of the whole."""
    key = F.lower("term")
    own = manual.groupBy("doc", key.alias("key")).agg(F.max_by(F.struct("term", "preferred"), "pos").alias("m"))
    rest = derived.groupBy("doc", key.alias("key")).agg(F.min_by(F.struct("term", "preferred"), "pos").alias("d"))
    rows = own.join(rest, ["doc", "key"], "full_outer")
    rows = rows.select("doc", "key", F.coalesce("m.term", "d.term").alias("term"), F.coalesce("m.preferred", "d.preferred").alias("preferred"), F.when(F.col("m").isNotNull(), "MANUAL").otherwise("DERIVED").alias("source"))
    listed = F.array_sort(F.collect_list(F.struct("key", "preferred", "source", "term")))
    said = F.to_json(F.transform(listed, lambda t: F.struct(t["preferred"].alias("preferredTranslation"), t["source"].alias("source"), t["term"].alias("term"))))
    revision = rows.groupBy("doc").agg(F.concat(F.lit("rev-"), F.left(F.sha2(said, 256), F.lit(12))).alias("revision"))
    return rows.drop("key").join(revision, "doc")


def rerendered(entries: DataFrame, selected: DataFrame, fresh: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the selected nodes translated again, and stage records after it: TRANSLATE and RENDER are new, INDEX goes. A selected node without an entry is an error."""
    missing = selected.join(entries.select("node", F.lit(True).alias("_has")), "node", "left")
    checked = missing.select(F.when(F.col("_has"), F.col("node")).otherwise(F.raise_error(F.concat(F.lit("no translation of node "), F.col("node").cast("string"))).cast("long")).alias("node"))
    out = upsert(entries, fresh.join(checked, "node", "left_semi"))
    kept = records.where("stage <> 'index'").withColumn("revision", F.when(F.col("stage").isin("translate", "render"), F.col("revision") + 1).otherwise(F.col("revision")))
    return out, kept
