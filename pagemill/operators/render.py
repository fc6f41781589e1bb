"""What rendering and the reader take from nodes: page fragments of anchors, plain text, neighbouring text, one status a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Margins of 25 mm in points, the least height of a fragment; cells shown, characters of context.
MARGIN, LEAST_HEIGHT = 70.866, 12.0
SHOWN_CELLS, CONTEXT = 20, 240
# Fixed values of a draft's score: base, for each evidence, for the best weight, and the cap.
BASE, EACH, BEST, CAP = 0.7, 0.1, 0.2, 0.95


def anchor_fragments(anchors: DataFrame, width: float, height: float) -> DataFrame:
    """A rectangle on each page from (p0, y0) to (p1, y1), which are swapped where reversed; other columns are kept."""
    start, end = F.struct(F.col("p0").alias("p"), F.col("y0").alias("y")), F.struct(F.col("p1").alias("p"), F.col("y1").alias("y"))
    rest = [c for c in anchors.columns if c not in {"p0", "y0", "p1", "y1"}]
    rows = anchors.select(*rest, F.least(start, end).alias("_a"), F.greatest(start, end).alias("_b"))
    rows = rows.select("*", F.explode(F.sequence("_a.p", "_b.p")).alias("on_page"))
    top = F.when(F.col("on_page") == F.col("_a.p"), F.col("_a.y")).otherwise(MARGIN)
    bottom = F.when(F.col("on_page") == F.col("_b.p"), F.col("_b.y")).otherwise(height - MARGIN)
    return rows.select(*rest, "on_page", F.lit(MARGIN).alias("x"), top.alias("y"), F.lit(width - 2 * MARGIN).alias("w"), F.greatest(bottom - top, F.lit(LEAST_HEIGHT)).alias("h"))


def in_order(value: str, *order: str) -> Column:
    """An aggregate: the values of a group as an array in the given order, then by value."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"])


def same_multiset(tokens: DataFrame, by: str, side: str) -> DataFrame:
    """by, same: whether each token is found as often where side is true as where it is false."""
    counts = tokens.groupBy(by, "token").agg(F.sum(F.when(F.col(side), 1).otherwise(-1)).alias("_d"))
    return counts.groupBy(by).agg(F.bool_and(F.col("_d") == 0).alias("same"))


def keep_first(*tables: DataFrame, by: str) -> DataFrame:
    """by, origin: of tables in order of precedence the first (from 0) that has a key."""
    rows = [t.select(by, F.lit(i).cast("long").alias("origin")) for i, t in enumerate(tables)]
    both = rows[0]
    for t in rows[1:]:
        both = both.unionByName(t)
    return both.groupBy(by).agg(F.min("origin").alias("origin"))


def finalised(boxes: DataFrame) -> DataFrame:
    """Score of each page's draft from the number of its evidence and the best confidence; its labels, best first, each once."""
    labels = boxes.groupBy("page", "label").agg(F.max("confidence").alias("_c"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("c"), "label"))), lambda s: s["label"])
    score = F.least(F.lit(CAP), F.lit(BASE) + EACH * F.sum("_n") + BEST * F.max("_c"))
    return labels.groupBy("page").agg(F.round(score, 4).alias("score"), F.array_join(ordered, ",").alias("labels"))
