"""Spatial joins and votes. All joins are on the page first, so their cost is that of the boxes of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..staging import staged
from .walk import walk

# Fixed values of the matching rules.
MATCH_IOU, MATCH_CONTAINMENT, SUPPRESS = 0.4, 0.7, 0.7
#: Similarity of unequal labels, in either order; 0 for other pairs.
LABEL_SIMILARITY = {
    ("TEXT", "PARAGRAPH_LIKE"): 0.9, ("TEXT", "HEADING_LIKE"): 0.5, ("TEXT", "CAPTION_LIKE"): 0.5, ("TEXT", "FOOTNOTE"): 0.5, ("TEXT", "LIST"): 0.7,
    ("PARAGRAPH_LIKE", "HEADING_LIKE"): 0.5, ("PARAGRAPH_LIKE", "CAPTION_LIKE"): 0.5, ("PARAGRAPH_LIKE", "FOOTNOTE"): 0.5, ("PARAGRAPH_LIKE", "LIST"): 0.7,
    ("HEADING_LIKE", "CAPTION_LIKE"): 0.3, ("FIGURE", "TABLE"): 0.3, ("HEADER", "HEADING_LIKE"): 0.3,
}
#: Weights of a provider by its place in the registry: primary, challenger, fallback, not listed.
AUTHORITY = {"primary": 1.5, "challenger": 1.2, "fallback": 1.0, "unlisted": 0.8}


def label_similarity(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (p, q), v in LABEL_SIMILARITY.items() for x in (f"{p}|{q}", v, f"{q}|{p}", v)])
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.element_at(table, F.concat_ws("|", a, b)), F.lit(0.0)))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page",)) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one page, the smaller id first."""
    return prefixed(boxes, "a_").join(prefixed(boxes, "b_"), "page").where("a_box_id < b_box_id")


def match_score(ignore_label: bool = False) -> Column:
    overlap, inside = G.iou("a_", "b_"), F.greatest(G.containment("a_", "b_"), G.containment("b_", "a_"))
    score = F.greatest(F.when(overlap >= MATCH_IOU, overlap).otherwise(0.0), F.when(inside >= MATCH_CONTAINMENT, inside).otherwise(0.0))
    return score if ignore_label else score * label_similarity(F.col("a_label"), F.col("b_label"))


def weight(provider: Column, label: Column) -> Column:
    rank = F.when((provider == "F") & (label != "TEXT"), "primary").when(provider == "F", "challenger").when(label == "TABLE", "fallback").otherwise("unlisted")
    return F.element_at(F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv]), rank)


def vote(boxes: DataFrame) -> DataFrame:
    """The label of each page with the greatest sum of confidence by authority; of equal sums the later name."""
    sums = boxes.groupBy("page", "label").agg(F.round(F.sum(F.col("confidence") * weight(F.col("provider"), F.col("label"))), 6).alias("total"))
    return sums.groupBy("page").agg(F.max(F.struct("total", "label")).alias("best"), F.sum(F.col("total").cast("decimal(20,6)")).cast("double").alias("_all")).select("page", F.col("best.label").alias("label"), F.round(F.when(F.col("_all") > 0, F.col("best.total") / F.col("_all")).otherwise(0.0), 5).alias("share"))


def suppressed(boxes: DataFrame) -> DataFrame:
    """Text boxes of which SUPPRESS or more lies in a table of their page."""
    text, tables = prefixed(boxes.where("label = 'TEXT'"), "b_"), prefixed(boxes.where("label = 'TABLE'"), "a_")
    return text.join(tables, "page").where(G.containment("a_", "b_") >= SUPPRESS).select("page", F.col("b_box_id").alias("box_id")).distinct()


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


#: Share of the smaller set of words from which two texts overlap.
TEXT_OVERLAP = 0.5


def text_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, overlap for all pairs of (a, words) and (b, words) that share TEXT_OVERLAP or more of the smaller set.

    Such a pair shares one of the rarest words of the smaller set, those that remain without the needed number, plus one;
    and the rarest word they share has as many of the larger set's behind it. So candidates meet on rare words only, and are
    verified on the sets. Words go by 64-bit hashes, which are made once.
    """
    hashed = lambda t: F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    left, right = (staged(t.withColumn("words", hashed(t)).withColumn("_k", F.size("words")).where("_k > 0"), "words") for t in (left, right))
    every = left.select(F.explode("words").alias("w")).union(right.select(F.explode("words")))
    counts = every.groupBy("w").agg(F.count("*").alias("_n"))

    def ranked(t: DataFrame, key: str) -> DataFrame:
        rows = t.select(key, "_k", F.explode("words").alias("w")).join(counts, "w")
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_n", "w")))

    x, y = ranked(left, "a"), ranked(right, "b")
    rare = lambda t: t.where(F.col("_r") <= F.col("_k") - F.ceil(TEXT_OVERLAP * F.col("_k")) + 1)
    behind = lambda k, small, r: F.col(r) <= F.col(k) - F.ceil(TEXT_OVERLAP * F.col(small)) + 1
    one = rare(y).select("b", "w", F.col("_k").alias("kb")).join(x.select("a", "w", "_k", "_r"), "w").where(F.col("_k") >= F.col("kb")).where(behind("_k", "kb", "_r"))
    two = rare(x).select("a", "w", "_k").join(y.select("b", "w", F.col("_k").alias("kb"), "_r"), "w").where(F.col("_k") < F.col("kb")).where(behind("kb", "_k", "_r"))
    met = one.select("a", "b").union(two.select("a", "b")).distinct()
    both = met.join(left.select("a", F.col("words").alias("wa")), "a").join(right.select("b", F.col("words").alias("wb")), "b")
    share = F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb"))
    return both.withColumn("overlap", share).where(F.col("overlap") >= TEXT_OVERLAP).select("a", "b", F.round("overlap", 6).alias("overlap"))


# Captions of figures and tables. Distance, overlap and width that end a pairing, and what each measure weighs.
CAPTION_DISTANCE, CAPTION_OVERLAP, CAPTION_WIDEST, CAPTION_WIDE, CAPTION_FONT, CAPTION_LEAST = 60.0, 0.4, 2.5, 1.1, 1.15, 0.6
CAPTION_WEIGHTS = {"distance": 0.35, "side": 0.2, "overlap": 0.25, "width": 0.1, "font": 0.1}


def _best_first(rows: list[dict]):
    """One to one, in the given order."""
    left, right = set(), set()
    for r in rows:
        if r["a"] not in left and r["b"] not in right:
            left.add(r["a"])
            right.add(r["b"])
            yield r["page"], r["a"], r["b"], r["score"]


def captions(regions: DataFrame) -> DataFrame:
    """regions: page, box_id, kind, label, text, font, x, y, w, h. page, caption, main, score: captions and what they caption, the best first, one to one.

    A caption is a text that is labelled or begins as one; one that names a figure does not caption a table, nor the other way round.
    """
    kind = T.caption_kind(F.trim("text"))
    rows = regions.withColumn("named", kind)
    a = prefixed(rows.where((F.col("kind") == "TEXT") & ((F.col("label") == "CAPTION_LIKE") | kind.isNotNull())), "a_")
    b = prefixed(rows.where(F.col("kind").isin("FIGURE", "TABLE")), "b_")
    below, above = F.col("a_y") - F.col("b_y") - F.col("b_h"), F.col("b_y") - F.col("a_y") - F.col("a_h")
    distance = F.when(below >= 0, below).when(above >= 0, above)
    side = F.when(below >= 0, F.col("b_kind") == "FIGURE").otherwise(F.col("b_kind") == "TABLE")
    overlap, ratio = G.x_overlap("a_", "b_"), F.when(F.col("b_w") > 0, F.col("a_w") / F.col("b_w")).otherwise(0.0)
    font = (F.col("b_font") <= 0) | (F.col("a_font") <= 0) | (F.col("a_font") <= CAPTION_FONT * F.col("b_font"))
    w = CAPTION_WEIGHTS
    score = w["distance"] * (1 - distance / CAPTION_DISTANCE) + F.when(side, w["side"]).otherwise(0.0) + w["overlap"] * overlap + F.when(ratio <= CAPTION_WIDE, w["width"]).otherwise(0.0) + F.when(font, w["font"]).otherwise(0.0)
    fits = (distance <= CAPTION_DISTANCE) & (overlap >= CAPTION_OVERLAP) & (ratio <= CAPTION_WIDEST) & (F.col("a_named").isNull() | (F.col("a_named") == F.col("b_kind")))
    scored = a.join(b, "page").where(fits).select("page", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round(score, 9).alias("score"), (-F.round(score, 9)).alias("worse")).where(F.col("score") >= CAPTION_LEAST)
    found = walk(scored, ["page"], ["worse", "a", "b"], _best_first, "page long, a long, b long, score double")
    return found.select("page", F.col("a").alias("caption"), F.col("b").alias("main"), F.round("score", 4).alias("score"))
