"""Queries over boxes: spatial matching, votes, captions, calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import matching as M
from ..sources import derive as D
from .registry import query

_PAIRS = f"""{D.BOXES}, p AS (SELECT a.page, a.box_id AS a, b.box_id AS b, a.label AS la, b.label AS lb, a.w * a.h AS area_a, b.w * b.h AS area_b, a.confidence AS ca,
    CASE WHEN least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)
    THEN (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) ELSE 0 END AS shared
  FROM d_boxes a JOIN d_boxes b ON a.page = b.page AND a.box_id < b.box_id),
q AS (SELECT *, shared / (area_a + area_b - shared) AS iou, greatest(shared / area_a, shared / area_b) AS inside, CASE WHEN la = lb THEN 1 WHEN la <> 'TEXT' AND lb <> 'TEXT' THEN 0.3::DOUBLE ELSE 0 END AS sim FROM p),
s AS (SELECT *, greatest(CASE WHEN iou >= 0.4::DOUBLE THEN iou ELSE 0 END, CASE WHEN inside >= 0.7::DOUBLE THEN inside ELSE 0 END) * sim AS score FROM q)"""


def _scored(spark, sf):
    return M.pairs(D.boxes(spark, sf)).withColumn("score", M.match_score()).where("score > 0")


@query(f"WITH {_PAIRS} SELECT page, a, b, round(iou, 5)::DOUBLE AS iou FROM q WHERE iou >= 0.4::DOUBLE")
def iou_pairs(spark, sf):
    rows = M.pairs(D.boxes(spark, sf)).withColumn("iou", G.iou("a_", "b_")).where("iou >= 0.4")
    return rows.select("page", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round("iou", 5).alias("iou"))


@query(f"WITH {_PAIRS} SELECT page, a, b, iou >= 0.4::DOUBLE AS by_overlap, inside >= 0.7::DOUBLE AS by_containment FROM q WHERE iou >= 0.4::DOUBLE OR inside >= 0.7::DOUBLE")
def overlap_pairs(spark, sf):
    """Boxes of any labels that show one region: they overlap, or one holds the other."""
    rows = M.pairs(D.boxes(spark, sf)).where(M.match_score(ignore_label=True) > 0)
    inside = F.greatest(G.containment("a_", "b_"), G.containment("b_", "a_"))
    return rows.select("page", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), (G.iou("a_", "b_") >= M.MATCH_IOU).alias("by_overlap"), (inside >= M.MATCH_CONTAINMENT).alias("by_containment"))


@query(f"WITH {_PAIRS} SELECT page, a, b, round(score, 5)::DOUBLE AS score FROM s WHERE score > 0")
def evidence_match(spark, sf):
    return _scored(spark, sf).select("page", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round("score", 5).alias("score"))


@query(f"WITH {_PAIRS} SELECT page, b, a, round(score, 5)::DOUBLE AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page, b ORDER BY round(score, 5) DESC, a) = 1")
def best_match(spark, sf):
    rows = _scored(spark, sf).select("page", F.col("b_box_id").alias("b"), F.col("a_box_id").alias("a"), F.round("score", 5).alias("score"))
    return M.first_of(rows, ["page", "b"], F.desc("score"), "a")


_VOTE = """CASE WHEN provider = 'F' AND label <> 'TEXT' THEN 1.5 WHEN provider = 'F' THEN 1.2 WHEN label = 'TABLE' THEN 1.0 ELSE 0.8 END::DOUBLE"""


@query(f"""WITH {D.BOXES}, t AS (SELECT page, label, round(sum(confidence * {_VOTE}), 6) AS total FROM d_boxes GROUP BY page, label)
SELECT page, label, round(total / sum_all, 5)::DOUBLE AS share FROM (SELECT *, sum(total::DECIMAL(20, 6)) OVER (PARTITION BY page)::DOUBLE AS sum_all FROM t) QUALIFY row_number() OVER (PARTITION BY page ORDER BY total DESC, label DESC) = 1""")
def label_vote(spark, sf):
    return M.vote(D.boxes(spark, sf))


@query(f"""WITH {_PAIRS.replace('a.box_id < b.box_id', "a.label = 'TABLE' AND b.label = 'TEXT'")} SELECT DISTINCT page, b AS box_id FROM p WHERE shared / area_b >= 0.7::DOUBLE""")
def structured_suppress(spark, sf):
    return M.suppressed(D.boxes(spark, sf))


@query(f"""WITH {D.BOXES}, o AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY box_id) AS t, row_number() OVER (PARTITION BY page ORDER BY y, x, box_id) AS f FROM d_boxes)
SELECT a.page, count(*) AS n_pairs, round(avg(CASE WHEN a.f < b.f THEN 1 ELSE 0 END), 6) AS accuracy, bool_and(a.f < b.f) AS exact FROM o a JOIN o b ON a.page = b.page AND a.t < b.t GROUP BY a.page""")
def pairwise_order(spark, sf):
    w = Window.partitionBy("page")
    o = D.boxes(spark, sf).select("page", F.row_number().over(w.orderBy("box_id")).alias("t"), F.row_number().over(w.orderBy("y", "x", "box_id")).alias("f"))
    rows = M.prefixed(o, "a_").join(M.prefixed(o, "b_"), "page").where("a_t < b_t")
    right = F.col("a_f") < F.col("b_f")
    return rows.groupBy("page").agg(F.count("*").alias("n_pairs"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.bool_and(right).alias("exact"))


_TRUTH = "d_truth AS (SELECT l.doc_id, l.quality = 1 AS correct, round(0.45 + (d.n_chars % 56) / 100.0, 2)::DOUBLE AS confidence FROM labels l JOIN documents d USING (doc_id))"
_BINS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0))
_BIN_SQL = "CASE " + " ".join(f"WHEN confidence < {hi} THEN {i}" for i, (_, hi) in enumerate(_BINS[:-1])) + " ELSE 5 END"
_CAL = f"""{_TRUTH}, c AS (SELECT b.bin, count(t.doc_id) AS total, count(*) FILTER (t.correct) AS correct FROM range(6) b(bin) LEFT JOIN (SELECT *, {_BIN_SQL} AS bin FROM d_truth) t ON t.bin = b.bin GROUP BY b.bin),
cal AS (SELECT bin::BIGINT AS bin, total, correct, CASE WHEN total > 0 THEN round(correct / total, 6) ELSE 0 END::DOUBLE AS accuracy FROM c)"""


def _calibration(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    truth = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("correct"), F.round(F.lit(0.45) + (F.col("n_chars") % 56) / 100, 2).alias("confidence"))
    which = F.lit(5)
    for i, (_, high) in reversed(list(enumerate(_BINS[:-1]))):
        which = F.when(F.col("confidence") < high, i).otherwise(which)
    counts = truth.groupBy(which.cast("long").alias("bin")).agg(F.count("*").alias("total"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    rows = spark.range(6).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0)
    return rows.withColumn("accuracy", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 6)).otherwise(0.0))


@query(f"WITH {_CAL} SELECT * FROM cal")
def calibration_bins(spark, sf):
    return _calibration(spark, sf)


@query(f"WITH {_CAL} SELECT coalesce(bool_and(accuracy <= next + 0.05), true) AS monotonic FROM (SELECT accuracy, lead(accuracy) OVER (ORDER BY bin) AS next FROM cal WHERE total > 0) WHERE next IS NOT NULL")
def calibration_monotonic(spark, sf):
    # Six rows at most, one for each bin.
    rows = _calibration(spark, sf).where("total > 0").withColumn("next", F.lead("accuracy").over(Window.partitionBy(F.lit(1)).orderBy("bin"))).where("next IS NOT NULL")
    return rows.agg(F.coalesce(F.bool_and(F.col("accuracy") <= F.col("next") + 0.05), F.lit(True)).alias("monotonic"))


@query(f"""WITH {D.BOXES}, s AS (SELECT page, 0 AS col, min(x + w / 2) AS seed FROM d_boxes GROUP BY page UNION ALL SELECT page, 1, max(x + w / 2) FROM d_boxes GROUP BY page)
SELECT b.page, b.box_id, s.col::BIGINT AS col FROM d_boxes b JOIN s USING (page) QUALIFY row_number() OVER (PARTITION BY b.page, b.box_id ORDER BY round(abs(b.x + b.w / 2 - s.seed), 6), s.col) = 1""")
def nearest_column(spark, sf):
    b = D.boxes(spark, sf)
    centre = F.col("x") + F.col("w") / 2
    seeds = b.groupBy("page").agg(F.min(centre).alias("left"), F.max(centre).alias("right"))
    rows = b.join(seeds, "page")
    far = lambda c: F.round(F.abs(centre - F.col(c)), 6)
    return rows.select("page", "box_id", F.when(far("left") <= far("right"), 0).otherwise(1).cast("long").alias("col"))
