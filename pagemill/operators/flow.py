"""Reading flow: edges from each region to the next, with why and how surely; notes flow by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

# Confidence of steps, and what makes a text go on.
SAME, NEXT, SPANNING, NOTES = 0.9, 0.85, 0.75, 0.8
GOES_ON, LOWER, FULL, LEAST, FULL_SHARE, MOST = 45, 25, 15, 60, 0.85, 95
CLOSERS = r"[)\]}\"'\x{201D}\x{2019}\x{BB}" + R.SPACE[1:-1] + "]+$"
STOPPING = ("HEADING_LIKE", "CAPTION_LIKE", "FOOTNOTE")
#: What of a region an edge looks at.
SEEN = ("region", "kind", "label", "text", "w", "last_w", "page", "band", "mode", "col", "col_x", "col_w", "page_multi")


def continuation(s: str, t: str) -> Column:
    """How surely the text of region t goes on that of s (column prefixes), or null: s ends no sentence, t begins in lower case, the last line of s is full. In hundredths, so that sums are exact."""
    c = lambda p, n: F.col(p + n)
    plain = (c(s, "kind") == "TEXT") & (c(t, "kind") == "TEXT") & ~c(s, "label").isin(*STOPPING) & ~c(t, "label").isin(*STOPPING)
    end = F.regexp_replace(R.strip(c(s, "text")), CLOSERS, "")
    score = F.lit(GOES_ON) + F.when(R.strip(c(t, "text")).rlike(r"^\p{Ll}"), LOWER).otherwise(0) + F.when((c(s, "w") > 0) & (c(s, "last_w") >= FULL_SHARE * c(s, "w")), FULL).otherwise(0)
    return F.when(plain & (end != "") & ~end.rlike("[.!?:]$") & (score >= LEAST), F.least(score, F.lit(MOST)) / 100)


def _position(s: str, t: str) -> Column:
    """Reason of a step by bands and columns."""
    c = lambda p, n: F.col(p + n)
    same_page = c(s, "page") == c(t, "page")
    same_band = same_page & (c(s, "band") == c(t, "band"))
    near = F.abs(c(s, "col_x") - c(t, "col_x")) <= F.greatest(F.lit(4.0), 0.02 * F.greatest(c(s, "col_w"), c(t, "col_w")))
    mode = lambda p, m: c(p, "mode") == m
    return (
        F.when(same_band, F.when(mode(s, "MULTI_COLUMN") & (c(s, "col") != c(t, "col")), "NEXT_COLUMN").otherwise("SAME_COLUMN"))
        .when(c(s, "mode").isNull() | c(t, "mode").isNull(), "SAME_COLUMN")
        .when(mode(t, "SPANNING") & ~mode(s, "SPANNING"), "BEFORE_SPANNING_BLOCK")
        .when(mode(s, "SPANNING") & ~mode(t, "SPANNING"), "AFTER_SPANNING_BLOCK")
        .when(mode(s, "MULTI_COLUMN") & mode(t, "FULL_WIDTH"), "BEFORE_SPANNING_BLOCK")
        .when(mode(s, "FULL_WIDTH") & mode(t, "MULTI_COLUMN"), "AFTER_SPANNING_BLOCK")
        .when(~same_page, F.when(c(t, "page_multi"), "NEXT_COLUMN").otherwise("SAME_COLUMN"))
        .when(mode(s, "MULTI_COLUMN") & mode(t, "MULTI_COLUMN"), F.when(near, "SAME_COLUMN").otherwise("NEXT_COLUMN"))
        .otherwise("SAME_COLUMN")
    )


def edges(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """doc, source, target, reason, confidence of the main flow. regions: doc, pos and SEEN, in flow order, no notes or furniture; captions: main, caption, score.

    A step between a figure or table and its caption is named so, one that goes on a text even before that. A text that a
    figure or formula interrupts has an edge to the next text that goes it on.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    rows = regions.select("doc", "pos", *(F.col(c).alias(f"t_{c}") for c in SEEN), *(F.lag(c).over(w).alias(f"s_{c}") for c in SEEN))
    kinds = {"NEXT_COLUMN": NEXT, "SAME_COLUMN": SAME}
    steps = rows.where("s_region IS NOT NULL").withColumn("_r", _position("s_", "t_")).withColumn("_c", continuation("s_", "t_"))
    a = captions.select(F.col("main").alias("s_region"), F.col("caption").alias("t_region"), F.col("score").alias("_a"))
    b = captions.select(F.col("caption").alias("s_region"), F.col("main").alias("t_region"), F.col("score").alias("_b"))
    steps = steps.join(a, ["s_region", "t_region"], "left").join(b, ["s_region", "t_region"], "left").withColumn("_k", F.coalesce("_a", "_b"))
    reason = F.when(F.col("_c").isNotNull(), "CONTINUATION").when(F.col("_k").isNotNull(), "CAPTION_ASSOCIATION").otherwise(F.col("_r"))
    base = F.lit(SPANNING)
    for name, value in kinds.items():
        base = F.when(F.col("_r") == name, value).otherwise(base)
    main = steps.select("doc", F.col("s_region").alias("source"), F.col("t_region").alias("target"), reason.alias("reason"), F.coalesce("_c", "_k", base).alias("confidence"))

    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "TEXT", F.struct(*SEEN)), ignorenulls=True).over(before)
    far = regions.withColumn("_l", last).withColumn("_p", F.lag("region").over(w)).where((F.col("kind") == "TEXT") & F.col("_l").isNotNull() & (F.col("_l.region") != F.col("_p")))
    far = far.select("doc", *(F.col(c).alias(f"t_{c}") for c in SEEN), *(F.col(f"_l.{c}").alias(f"s_{c}") for c in SEEN)).withColumn("_c", continuation("s_", "t_")).where("_c IS NOT NULL")
    return main.union(far.select("doc", F.col("s_region"), F.col("t_region"), F.lit("CONTINUATION"), F.col("_c")))


def note_edges(notes: DataFrame) -> DataFrame:
    """Each note of a page (doc, page, region, x, y) to the one below it."""
    after = F.lead("region").over(Window.partitionBy("doc", "page").orderBy("y", "x", "region"))
    return notes.withColumn("target", after).where("target IS NOT NULL").select("doc", F.col("region").alias("source"), "target", F.lit("FOOTNOTE_FLOW").alias("reason"), F.lit(NOTES).alias("confidence"))


def nodes(placed: DataFrame, notes: DataFrame, every: DataFrame) -> DataFrame:
    """doc, region, position: regions of bands by page, then the notes of the page, then what is left; the first place counts.

    placed: doc, page, region, pos; notes: doc, page, region, pos; every: doc, page, region, pos.
    """
    tagged = [t.select("doc", "page", "region", "pos", F.lit(i).alias("turn")) for i, t in enumerate((placed, notes))]
    rest = every.select("doc", F.lit(None).cast("long").alias("page"), "region", "pos", F.lit(2).alias("turn"))
    key = F.struct(F.when(F.col("turn") == 2, 1).otherwise(0).alias("a"), "page", "turn", "pos", "region")
    first = tagged[0].union(tagged[1]).union(rest).groupBy("doc", "region").agg(F.min(key).alias("k"))
    return first.select("doc", "region", F.row_number().over(Window.partitionBy("doc").orderBy("k")).cast("long").alias("position"))
