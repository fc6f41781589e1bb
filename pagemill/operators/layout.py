"""Page layout: furniture, lines, strips, paragraphs, reading flow. Spans have doc_id, page, line_no, text, x, y, w, h, font."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the layout rules.
HEADER_STRIP, FOOTER_STRIP, SMALL_FONT = 0.06, 0.85, 0.9
STRIP_GAP, ROW_GAP, LINE_SHARE = 9.0, 0.6, 0.4
FULL_LINE = 0.85
PAGE = ["doc_id", "page"]


def body_font(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """The exact median font size, the height standing in for a missing size."""
    size = F.coalesce(F.when(F.col("font") > 0, F.col("font")), F.col("h"))
    return spans.groupBy(by).agg(F.percentile(size, 0.5).alias("body_font"))


def zones(spans: DataFrame, fonts: DataFrame, page_height: float) -> DataFrame:
    """spans with zone: header, footer or body."""
    size = F.coalesce(F.when(F.col("font") > 0, F.col("font")), F.col("h"))
    bare = F.trim("text")
    small = (F.col("body_font") <= 0) | (size <= SMALL_FONT * F.col("body_font"))
    header = small & (F.length(bare) <= 120) & (F.col("y") + F.col("h") <= HEADER_STRIP * page_height)
    footer = (F.col("y") >= FOOTER_STRIP * page_height) & (bare.rlike(r"^\p{Nd}+$") | (small & (F.length(bare) <= 4)))
    return spans.join(fonts, "doc_id").withColumn("zone", F.when(header, "header").when(footer, "footer").otherwise("body"))


def islands(rows: DataFrame, by: list[str], order: list[str], start: Column, name: str) -> DataFrame:
    """Numbers runs: start tells, from the rows before, whether a row begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_s", start.cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def strips(spans: DataFrame) -> DataFrame:
    """A strip ends where the next span begins over STRIP_GAP below all spans before."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")
    lowest = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(spans.withColumn("_low", lowest), PAGE, ["y", "x", "line_no"], F.coalesce(F.col("y") - F.col("_low") > STRIP_GAP, F.lit(True)), "strip").drop("_low")


def visual_lines(spans: DataFrame) -> DataFrame:
    """Spans share a line with the one before if their tops are near or their heights overlap."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")
    y, h = F.lag("y").over(w), F.lag("h").over(w)
    marked = spans.withColumn("_y", y).withColumn("_h", h)
    near = F.abs(F.col("y") - F.col("_y")) <= LINE_SHARE * F.greatest("h", "_h")
    overlap = F.least(F.col("y") + F.col("h"), F.col("_y") + F.col("_h")) > F.greatest("y", "_y")
    return islands(marked, PAGE, ["y", "x", "line_no"], ~F.coalesce(near | overlap, F.lit(False)), "visual_line").drop("_y", "_h")


def row_clusters(spans: DataFrame) -> DataFrame:
    """A row begins where the gap to the span before exceeds ROW_GAP of the larger height."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")
    marked = spans.withColumn("_b", F.lag(F.col("y") + F.col("h")).over(w)).withColumn("_h", F.lag("h").over(w))
    return islands(marked, PAGE, ["y", "x", "line_no"], F.coalesce(F.col("y") - F.col("_b") > ROW_GAP * F.greatest("h", "_h"), F.lit(True)), "row_no").drop("_b", "_h")


def paragraph_pieces(spans: DataFrame, heading: Column) -> DataFrame:
    """A piece begins after a gap of over 1.5 lines (of the taller of two) before a text, at a numbered heading, and after a one-line heading."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")
    marked = spans.withColumn("_head", heading).withColumn("_gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)).withColumn("_h", F.lag("h").over(w)).withColumn("_after", F.lag("_head").over(w))
    far = (F.col("_gap") > 1.5 * F.greatest("h", "_h", F.lit(1.0))) & (F.trim("text") != "")
    start = F.when(F.col("_gap").isNull(), True).otherwise(far | F.col("_head") | F.col("_after"))
    return islands(marked, PAGE, ["y", "x", "line_no"], start, "piece").drop("_head", "_gap", "_after", "_h")


def numeric_runs(spans: DataFrame) -> DataFrame:
    """Runs of spans flush left and right within 2.5, at most 3 heights (of the taller of two) apart, of 3 rows or more, half of which end in a number."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")
    marked = spans.withColumn("_l", F.lag("x").over(w)).withColumn("_r", F.lag(F.col("x") + F.col("w")).over(w)).withColumn("_b", F.lag(F.col("y") + F.col("h")).over(w)).withColumn("_h", F.lag("h").over(w))
    tall = F.greatest("h", "_h", F.lit(1.0))
    flush = (F.abs(F.col("x") - F.col("_l")) <= 2.5) & (F.abs(F.col("x") + F.col("w") - F.col("_r")) <= 2.5) & (F.col("y") - F.col("_b")).between(F.lit(0.0), 3 * tall)
    runs = islands(marked, PAGE, ["y", "x", "line_no"], ~F.coalesce(flush, F.lit(False)), "run")
    tail = F.col("text").rlike(r"[\p{Nd}.,%]+\)?\s*$").cast("long")
    return runs.groupBy(*PAGE, "run").agg(F.count("*").alias("n_rows"), F.sum(tail).alias("n_numeric"), F.min("y").alias("top")).where("n_rows >= 3 AND 2 * n_numeric >= n_rows")


def continuation(pieces: DataFrame, closers: str) -> DataFrame:
    """Edges from a piece to the next whose text goes on: confidence by lower case and a full last line."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = pieces.withColumn("next_pos", F.lead("pos").over(w)).withColumn("next_text", F.lead("text").over(w)).where("next_pos IS NOT NULL")
    end = F.regexp_replace(F.trim("text"), closers, "")
    open_end = (end != "") & ~end.rlike(r"[.!?:]$")
    # Round numbers of hundredths are summed, so both engines agree on the threshold.
    score = F.lit(45) + F.when(F.trim("next_text").rlike(r"^\p{Ll}"), 25).otherwise(0) + F.when(F.length("text") >= FULL_LINE * 200, 15).otherwise(0)
    rows = rows.withColumn("score", score)
    return rows.where(open_end & (F.col("score") >= 60)).select("doc_id", "pos", "next_pos", (F.least("score", F.lit(95)) / 100).alias("confidence"))


def chains(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Maximal runs of continued pieces, with their least confidence; only runs of several pieces."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    into = edges.select("doc_id", F.col("next_pos").alias("pos"), F.col("confidence").alias("into"))
    rows = pieces.select("doc_id", "pos").join(into, ["doc_id", "pos"], "left")
    rows = rows.withColumn("chain", F.sum(F.col("into").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "chain").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_pieces"), F.min("into").alias("confidence")).where("n_pieces > 1").drop("chain")
