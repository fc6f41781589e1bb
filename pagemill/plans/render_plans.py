"""Queries over nodes and their rendering: anchors, context, plain text, merges, drafts and flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import render as E
from ..sources import derive as D
from .registry import query

_ANCHORS = f"""{D.BOXES}, anchors AS (SELECT page, box_id, {{'p': box_id, 'y': y}} AS s, {{'p': box_id + floor(x / 8)::BIGINT % 4 - 1, 'y': h * 10}} AS e FROM d_boxes),
a AS (SELECT page, box_id, least(s, e) AS lo, greatest(s, e) AS hi FROM anchors), f AS (SELECT *, unnest(range(lo.p, hi.p + 1)) AS on_page FROM a),
t AS (SELECT *, CASE WHEN on_page = lo.p THEN lo.y ELSE 70.866 END::DOUBLE AS top, CASE WHEN on_page = hi.p THEN hi.y ELSE 600 - 70.866 END::DOUBLE AS bottom FROM f)"""


@query(f"WITH {_ANCHORS} SELECT page, box_id, on_page, round(top, 4) AS y, round(greatest(bottom - top, 12), 4)::DOUBLE AS h FROM t")
def render_anchors(spark, sf):
    boxes = D.boxes(spark, sf)
    anchors = boxes.select("page", "box_id", F.col("box_id").alias("p0"), F.col("y").alias("y0"), (F.col("box_id") + F.floor(F.col("x") / 8) % 4 - 1).alias("p1"), (F.col("h") * 10).alias("y1"))
    return E.anchor_fragments(anchors, D.PAGE_WIDTH, D.PAGE_HEIGHT).select("page", "box_id", "on_page", F.round("y", 4).alias("y"), F.round("h", 4).alias("h"))


_NAMES = "names AS (SELECT p_partkey, min(p_name) AS name, min(p_brand) AS brand FROM part GROUP BY p_partkey)"


def _named(spark, sf):
    names = D.table(spark, sf, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.min("p_name").alias("name"), F.min("p_brand").alias("brand"))
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(names, "l_partkey")


@query(f"WITH {_NAMES} SELECT l_orderkey AS region, sha256(string_agg(name, ' ' ORDER BY l_linenumber, l_partkey)) AS text_sha, count(*) AS n_spans FROM lineitem JOIN names ON p_partkey = l_partkey GROUP BY l_orderkey")
def region_text(spark, sf):
    """Texts of a region's spans in the order of its ids; ids without a span are left out."""
    text = F.array_join(E.in_order("name", "l_linenumber", "l_partkey"), " ")
    return _named(spark, sf).groupBy(F.col("l_orderkey").alias("region")).agg(F.sha2(text, 256).alias("text_sha"), F.count("*").alias("n_spans"))


@query("""WITH t AS (SELECT conv_id, role = 'user' AS side, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS token FROM conversations), c AS (SELECT conv_id, token, sum(CASE WHEN side THEN 1 ELSE -1 END) AS d FROM t GROUP BY ALL)
SELECT conv_id, bool_and(d = 0) AS same FROM c GROUP BY conv_id""")
def placeholder_equality(spark, sf):
    tokens = D.table(spark, sf, "conversations").select("conv_id", (F.col("role") == "user").alias("side"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("token"))
    return E.same_multiset(tokens, "conv_id", "side")


@query("SELECT doc_id, min(origin)::BIGINT AS origin FROM (SELECT doc_id, 0 AS origin FROM labels UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY doc_id")
def issue_store_merge(spark, sf):
    return E.keep_first(D.table(spark, sf, "labels"), D.table(spark, sf, "documents"), by="doc_id")


@query(f"""WITH {D.BOXES}, l AS (SELECT page, label, max(confidence) AS c, count(*) AS n FROM d_boxes GROUP BY page, label)
SELECT page, round(least(0.95, 0.7 + 0.1 * sum(n) + 0.2 * max(c)), 4)::DOUBLE AS score, string_agg(label, ',' ORDER BY c DESC, label) AS labels FROM l GROUP BY page""")
def draft_finalisation(spark, sf):
    return E.finalised(D.boxes(spark, sf))


@query(f"WITH {D.BOXES} SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY round(w * h, 4) DESC, box_id)::BIGINT AS position, round(100 * x / 560, 4) AS left_pct, round(100 * w / 560, 4) AS width_pct FROM d_boxes")
def overlay_order(spark, sf):
    """Largest first, so that smaller fragments lie on top."""
    w = Window.partitionBy("page").orderBy(F.desc(F.round(F.col("w") * F.col("h"), 4)), "box_id")
    pct = lambda c: F.round(100 * F.col(c) / D.PAGE_WIDTH, 4)
    return D.boxes(spark, sf).select("page", "box_id", F.row_number().over(w).cast("long").alias("position"), pct("x").alias("left_pct"), pct("w").alias("width_pct"))


@query(f"WITH {D.BOXES}, k AS (SELECT page, count(*) FILTER (label = 'TEXT') >= 1 AS t, count(*) FILTER (label = 'FIGURE') >= 1 AS f, count(*) FILTER (label = 'TABLE') >= 2 AS b FROM d_boxes GROUP BY page) SELECT page, round((t::INT + f::INT + b::INT) / 3, 6)::DOUBLE AS score FROM k")
def expectation_score(spark, sf):
    """The share of expected kinds that a page has in the expected number."""
    expected = {"TEXT": 1, "FIGURE": 1, "TABLE": 2}
    passed = [(F.count(F.when(F.col("label") == k, 1)) >= n).cast("int") for k, n in expected.items()]
    return D.boxes(spark, sf).groupBy("page").agg(F.round((passed[0] + passed[1] + passed[2]) / len(expected), 6).alias("score"))


@query("SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE arg_max(role, (turn, role)) END AS model FROM conversations GROUP BY conv_id")
def layer_model(spark, sf):
    """The one model of a layer, or that of its last pass."""
    last = F.max(F.struct("turn", "role"))["role"]
    return D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.when(F.count_distinct("role") == 1, F.min("role")).otherwise(last).alias("model"))


@query(f"WITH {D.BOXES} SELECT page, round_even(x, 0)::DOUBLE AS x, round_even(y, 0)::DOUBLE AS y, label, count(*) AS n FROM d_boxes GROUP BY ALL")
def match_key(spark, sf):
    return D.boxes(spark, sf).groupBy("page", F.bround("x").alias("x"), F.bround("y").alias("y"), "label").agg(F.count("*").alias("n"))
