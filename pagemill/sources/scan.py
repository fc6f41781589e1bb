"""Physical objects of pages, from tables of what a decoder finds on them. Decoding the files is left to whoever fills the tables; all rules after it are here.

pages: source (hex digest of the file), page, width, height (as shown), rotation.
rects: source, page, rect, left, bottom, right, top, text; chars: source, page, rect, seq, char, x, w, a row a character,
or a row for several that follow each other: seq of the first, char with a code point for each, lists x and w.
objects: source, page, seq, depth, type (image, path or another), left, bottom, right, top; null where a box cannot be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import text as T
from ..operators import structure as S
from ..operators.walk import changes, whole

MAX_DEPTH = 16
KINDS = ("text", "image", "vector")
#: What a row of a page is, in the order in which rows lie; rectangles and runs of characters stand together.
PAGE, TEXT, IMAGE, VECTOR = range(4)
_PARTS = "array<struct<seq: long, x: double, right: double, text: string>>"
_FOUND = "source string, page long, kind string, n long, text string, font double, x double, y double, w double, h double, width double, height double, rotation double, position long"


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, source, content of all files below a folder; equal bytes are one source."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.sha2("content", 256).alias("source"), "content")


def _shown(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with raw x, y, w, h on their pages as shown."""
    box = G.to_page(F.struct("x", "y", "w", "h"), F.col("rotation"), F.col("width"), F.col("height"))
    rest = [c for c in rows.columns if c not in ("x", "y", "w", "h")]
    return rows.join(pages, ["source", "page"]).select(*rest, box.alias("box")).select(*rest, "box.*")


def _id(kind: Column, order: Column) -> Column:
    return T.stable_id(F.col("source"), kind, F.col("page"), order)


def _drawn(objects: DataFrame) -> DataFrame:
    """Images and vectors of a box with an area."""
    kind = F.when(F.col("type") == "image", "image").when(F.col("type") == "path", "vector")
    return objects.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("depth") <= MAX_DEPTH) & (F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom")))


def drawn(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Images and vectors of a box with an area, numbered by kind within their page in stream order; ids follow the numbers."""
    n = F.row_number().over(Window.partitionBy("source", "page", "kind").orderBy("seq")).cast("long") - 1
    rows = _drawn(objects).select("source", "page", "kind", n.alias("n"), F.col("left").alias("x"), F.col("bottom").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("top") - F.col("bottom")).alias("h"))
    return _shown(pages, rows).withColumn("object", _id(F.col("kind"), F.col("n")))


def _runs(chars: DataFrame) -> DataFrame:
    """Runs of characters as they are, or of single ones lists of parts that no cell gap cuts, made where the characters are: none is dealt out or sorted as a row of its own."""
    chars = chars.where("source IS NOT NULL AND page IS NOT NULL AND rect IS NOT NULL")
    keys = [F.col("source").cast("string").alias("source"), F.col("page").cast("long").alias("page"), "rect"]
    if isinstance(chars.schema["x"].dataType, K.ArrayType):
        return chars.where("char IS NOT NULL").select(*keys, F.col("seq").cast("long").alias("seq"), "char", *(F.coalesce(F.col(c), F.array()).cast("array<double>").alias(c) for c in ("x", "w")))
    rows = chars.select(*keys, F.col("seq").cast("long").alias("seq"), "char", F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))
    schema = K.StructType([*rows.schema.fields[:3], K.StructField("parts", K._parse_datatype_string(_PARTS))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = changes(batch, ["source", "page", "rect"])
                first = pa.array(np.flatnonzero(new))
                out = [*(batch.column(i).take(first) for i in range(3)), _parts(np.cumsum(new) - 1, batch.columns[3:], len(first))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)


def _parts_of_runs(seq: pa.Array, char: pa.Array, x: pa.Array, w: pa.Array) -> pa.Array:
    """Lists of parts of runs of characters."""
    n = pc.utf8_length(char).to_numpy(zero_copy_only=False)
    if any((pc.list_value_length(c).to_numpy(zero_copy_only=False) != n).any() for c in (x, w)):
        raise ValueError("a run of characters without a place for each")
    run = np.repeat(np.arange(len(n)), n)
    char = char.cast(pa.large_string())
    at = _edges(char)
    data = np.frombuffer(char.buffers()[2], np.uint8)[at[0] : at[-1]] if len(run) else np.zeros(0, np.uint8)
    edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) + at[0]
    single = pa.LargeStringArray.from_buffers(len(run), pa.py_buffer(edges), char.buffers()[2])
    return _parts(run, [pa.array(seq.to_numpy(zero_copy_only=False)[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)), single, x.flatten(), w.flatten()], len(n))


def _parts(run: np.ndarray, columns: list[pa.Array], n_runs: int) -> pa.Array:
    """Lists of parts, one for each run of characters (columns seq, char, x, w; run counts up).

    Printable characters with consecutive numbers and no gap over CELL_GAP, the least threshold of any font, are a part, with the space between them;
    other space is a part without a place.
    """
    seq, char, x, w = columns
    seq = pc.fill_null(seq, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    signs = char.dictionary_encode()
    shown = np.append([bool(c and c.strip()) for c in signs.dictionary.to_pylist()], False)[pc.fill_null(signs.indices, -1).to_numpy(zero_copy_only=False)].astype(bool)
    at = np.flatnonzero(shown)
    if (x.null_count or w.null_count) and (x.take(pa.array(at)).null_count or w.take(pa.array(at)).null_count):
        raise ValueError("a character without a place")
    x, w = _floats(x)[at], _floats(w)[at]
    right = x + w
    after = np.zeros(len(seq), bool)
    after[1:] = (run[1:] == run[:-1]) & (seq[1:] == seq[:-1] + 1)
    stretch = np.cumsum(~after)[at]
    linked = np.zeros(len(at) + 1, bool)
    linked[1:-1] = (stretch[1:] == stretch[:-1]) & (x[1:] - right[:-1] <= S.CELL_GAP)
    # Space belongs to a part if the next printable character does; other space goes on the space before it.
    begins = ~linked[np.searchsorted(at, np.arange(len(seq)))]
    begins[1:] &= shown[1:] | shown[:-1] | ~after[1:]
    starts, heads = np.flatnonzero(begins), np.flatnonzero(~linked[:-1])
    left, reach, none = np.zeros(len(starts)), np.zeros(len(starts)), ~shown[starts]
    if len(heads):
        left[~none], reach[~none] = x[heads], np.fmax.reduceat(right, heads)
    char = pc.fill_null(char, "").cast(pa.large_string())
    edges = _edges(char)[np.append(starts, len(char))]
    texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), char.buffers()[2])
    held = pa.StructArray.from_arrays([pa.array(seq[starts]), pa.array(left, mask=none), pa.array(reach, mask=none), texts.cast(pa.string())], ["seq", "x", "right", "text"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(run[starts], minlength=n_runs))), pa.int32()), held)


def _edges(texts: pa.Array) -> np.ndarray:
    """Where each of the texts begins in their bytes, and where the last ends."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _cuts(rect: np.ndarray, x: np.ndarray, right: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts in order: which begin a piece, as split_cells() has it, and how far right their piece reaches by then.

    Where no part of a rectangle ends left of the one before, the last one is the furthest; others are taken one by one.
    """
    first = np.append(True, rect[1:] != rect[:-1])
    cut, reach = first.copy(), right.copy()
    cut[1:] |= x[1:] - right[:-1] > most[1:]
    odd = ~first[1:] & ~(right[1:] >= right[:-1])
    for i in np.flatnonzero(np.isin(rect, np.unique(rect[1:][odd]))) if odd.any() else ():
        cut[i] = first[i] or x[i] - reach[i - 1] > most[i]
        reach[i] = right[i] if cut[i] else max(reach[i - 1], right[i])
    return cut, reach


def _pieces(runs: pa.Array, rect: np.ndarray, font: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rectangle, left edge, width and text of each cell piece; rect numbers the rectangles of runs of parts, in order, and font is by that number."""
    rect = np.repeat(rect, pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    seq, x, right, text = runs.flatten().flatten()
    seq = seq.to_numpy(zero_copy_only=False)
    if ((rect[1:] == rect[:-1]) & (seq[1:] < seq[:-1])).any():
        order = np.lexsort((seq, rect))
        rect, (x, right, text) = rect[order], (c.take(pa.array(order)) for c in (x, right, text))
    at = np.flatnonzero(pc.is_valid(x).to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.empty(0), np.empty(0), pa.array([], pa.large_string())
    rect, x, right = rect[at], _floats(x)[at], _floats(right)[at]
    height = font[rect]
    cut, reach = _cuts(rect, x, right, S.CELL_GAP * np.where(1.0 > height, 1.0, height))
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(at)) - 1
    # The text of a piece is a stretch of the parts' bytes: those from its first printable one to its last.
    text = text.cast(pa.large_string())
    edges = _edges(text)
    edges = np.stack([edges[at[starts]], edges[at[ends] + 1]], 1).ravel()
    texts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), text.buffers()[2]).take(pa.array(np.arange(0, len(edges), 2)))
    return rect[starts], x[starts], reach[ends] - x[starts], texts


def _lines(page: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, text: pa.Array, font: np.ndarray) -> tuple:
    """Pieces in stream order to lines, as merged_fragments() has it: page, number, x, y, w, h, text and font. Only pages on which a piece goes on the one before it need that rule."""
    right, bottom = x + w, y + h
    wide, high = right - x, bottom - y
    least, gap = np.minimum(high[:-1], high[1:]), x[1:] - right[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (np.minimum(bottom[:-1], bottom[1:]) - np.maximum(y[:-1], y[1:])) / least
    goes_on = (page[1:] == page[:-1]) & ~(least <= 0) & ~(share < S.MERGE_OVERLAP) & ~(gap < 0) & ~(gap > S.MERGE_GAP)
    apart = ~np.isin(page, page[1:][goes_on]) if goes_on.any() else np.ones(len(page), bool)
    own = page[apart]
    out = [own, _numbers(own), *(c[apart] for c in (x, y, wide, high)), text.filter(pa.array(apart)), font[apart]]
    if apart.all():
        return tuple(out)
    names = ("page", "x", "y", "w", "h", "text", "font")
    rest = [dict(zip(names, r, strict=True)) for r in zip(*(c[~apart].tolist() for c in (page, x, y, w, h)), text.filter(pa.array(~apart)).to_pylist(), font[~apart].tolist(), strict=True)]
    merged = list(zip(*(r for _, g in groupby(rest, itemgetter("page")) for r in S.merged_fragments(list(g))), strict=True))
    joined = [np.append(a, b) for a, b in zip(out[:6] + out[7:], merged[:6] + merged[7:], strict=True)]
    return *joined[:6], pa.concat_arrays([out[6], pa.array(merged[6], pa.large_string())]), joined[6]


def _numbers(groups: np.ndarray) -> np.ndarray:
    """The place of each in its group; groups lie side by side."""
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[: len(groups)]
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def _objects_of_pages(rows: pa.RecordBatch, kinds: pa.Schema) -> pa.RecordBatch:
    """All objects of whole pages, whose rows lie as _found() sorts them; pages of which nothing is known have none."""
    new = changes(rows, ["source", "page"])
    page, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    role, a, b, c, d = (_floats(rows.column(k)) for k in ("role", "a", "b", "c", "d"))
    known = np.full(len(starts), -1)
    sizes = np.flatnonzero(role == PAGE)
    known[page[sizes]] = sizes
    kept = known[page] >= 0
    # Runs of characters follow their rectangle.
    is_run = pc.is_valid(rows.column("parts" if "parts" in rows.schema.names else "char")).to_numpy(zero_copy_only=False)
    rects, runs = np.flatnonzero(kept & (role == TEXT) & ~is_run), np.flatnonzero(kept & (role == TEXT) & is_run)
    own = np.searchsorted(rects, runs) - 1
    name = pc.fill_null(rows.column("rect").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    if len(rects):
        held = (own >= 0) & (page[rects[own]] == page[runs]) & (name[rects[own]] == name[runs])
        runs, own = runs[held], own[held]
    else:
        runs = own = rects
    font = b[rects] - a[rects]
    parts = [rows.column(c).take(pa.array(runs)) for c in (["parts"] if "parts" in rows.schema.names else ["seq", "char", "x", "w"])]
    rect, x, w, text = _pieces(parts[0] if len(parts) == 1 else _parts_of_runs(*parts), own, font)
    at, n, x, y, w, h, text, size = _lines(page[rects[rect]], x, a[rects[rect]], w, font[rect], text, font[rect])
    count = np.bincount(at, minlength=len(starts))

    shapes = np.flatnonzero(kept & (role >= IMAGE))
    number = _numbers(page[shapes] * 4 + role[shapes])
    images = np.bincount(page[shapes][role[shapes] == IMAGE], minlength=len(starts))
    before = count[page[shapes]] + np.where(role[shapes] == VECTOR, images[page[shapes]], 0)

    at, n, position = np.append(at, page[shapes]), np.append(n, number), np.append(n, number + before) + 1
    kind = np.append(np.zeros(len(text), np.int32), (role[shapes] - TEXT).astype(np.int32))
    none = len(shapes)
    sizes = known[at]
    out = {
        "source": rows.column("source").take(pa.array(starts[at])), "page": rows.column("page").take(pa.array(starts[at])), "kind": pa.array(KINDS).take(pa.array(kind)), "n": n,
        "text": pa.concat_arrays([text.cast(pa.string()), pa.nulls(none, pa.string())]), "font": pa.concat_arrays([pa.array(size, pa.float64()), pa.nulls(none, pa.float64())]),
        "x": np.append(x, a[shapes]), "y": np.append(y, b[shapes]), "w": np.append(w, c[shapes] - a[shapes]), "h": np.append(h, d[shapes] - b[shapes]), "width": a[sizes], "height": b[sizes], "rotation": c[sizes], "position": position,
    }
    return pa.RecordBatch.from_arrays([(v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for v, f in zip(out.values(), kinds, strict=True)], schema=kinds)


def _found(rects: DataFrame, chars: DataFrame, objects: DataFrame | None, pages: DataFrame) -> DataFrame:
    """All objects with their position on the page: spans, then images, then vectors.

    Rows of all tables lie together by page, so each is dealt out once at most, and not at all where its table is by page already; one pass cuts, joins and numbers.
    """
    of = lambda df, role, *cols: df.where("source IS NOT NULL AND page IS NOT NULL").select(F.col("source").cast("string").alias("source"), F.col("page").cast("long").alias("page"), role.alias("role"), *cols)
    numbers = lambda *names: [F.col(c).cast("double").alias(k) for k, c in zip("abcd", names, strict=False)]
    kept = rects.where((F.trim(F.regexp_replace("text", r"\s", "")) != "") & F.col("rect").isNotNull())
    runs = _runs(chars)
    run = "parts" if "parts" in runs.columns else "char"
    tables = [of(kept, F.lit(TEXT), "rect", *numbers("bottom", "top")), of(runs, F.lit(TEXT), *runs.columns[2:])]
    if objects is not None:
        tables.append(of(_drawn(objects), F.when(F.col("kind") == "image", IMAGE).otherwise(VECTOR), "seq", *numbers("left", "bottom", "right", "top")))
    rows = of(pages, F.lit(PAGE), F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("seq"), *numbers("width", "height", "rotation"))
    for table in tables:
        rows = rows.unionByName(table, allowMissingColumns=True)
    kinds = to_arrow_schema(K._parse_datatype_string(_FOUND))
    # The window deals out what is not by page yet, and sorts.
    place = F.row_number().over(Window.partitionBy("page", "source").orderBy("role", "rect", F.col(run).isNotNull(), "seq"))
    found = rows.withColumn("at", place).mapInArrow(lambda batches: (_objects_of_pages(b, kinds) for b in whole(batches, ["source", "page"])), _FOUND)
    box = G.to_page(F.struct("x", "y", "w", "h"), F.col("rotation"), F.col("width"), F.col("height"))
    font = F.nullif(F.bround("font", 2), F.lit(0.0)).alias("font")
    return found.select("source", "page", "kind", "n", "text", font, box.alias("box"), _id(F.col("kind"), F.col("n")).alias("object"), "position").select("source", "page", "kind", "n", "text", "font", "box.*", "object", "position")


def text_spans(rects: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles with text, cut at cell gaps, joined to lines; a span a line, its font the height of its highest part, null for none."""
    return _found(rects, chars, None, pages).drop("position")


def physical_objects(rects: DataFrame, chars: DataFrame, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """All objects with their position on the page: spans, then images, then vectors."""
    return _found(rects, chars, objects, pages)
