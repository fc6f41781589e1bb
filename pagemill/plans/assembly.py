"""Queries over trees, integrity, jobs and rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import jobs as J
from ..operators import tree as R
from ..sources import derive as D
from .registry import query

_WALK = f"""WITH RECURSIVE {D.TREE}, walk AS (SELECT node, 0 AS depth, [pos] AS path FROM d_tree WHERE node = 'root' UNION ALL SELECT t.node, w.depth + 1, list_append(w.path, t.pos) FROM walk w JOIN d_tree t ON t.parent = w.node)"""


@query(f"{_WALK} SELECT node, depth::BIGINT AS depth, array_to_string(path, '.') AS path FROM walk")
def tree_preorder(spark, sf):
    rows = R.preorder(D.tree(spark, sf), "root")
    return rows.select("node", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"))


@query(f"{_WALK} SELECT node, 'unreachable' AS rule, 'ERROR' AS severity FROM d_tree WHERE node NOT IN (SELECT node FROM walk)")
def tree_orphans(spark, sf):
    return R.orphans(D.tree(spark, sf), "root").select("node", F.lit("unreachable").alias("rule"), F.lit("ERROR").alias("severity"))


@query(f"{_WALK}, up AS (SELECT t.node, w.path[2] AS region FROM walk w JOIN d_tree t USING (node) WHERE t.level >= 3) SELECT region, count(*) AS n_descendants FROM up GROUP BY region")
def ancestor_counts(spark, sf):
    tree = D.tree(spark, sf)
    rows = R.preorder(tree, "root").join(tree.select("node", "level"), "node").where("level >= 3")
    return rows.groupBy(F.col("path")[1].alias("region")).agg(F.count("*").alias("n_descendants"))


_HEADS = "heads AS (SELECT l_suppkey AS doc, l_orderkey AS pos, (min(l_linenumber) % 3 + 1)::BIGINT AS level FROM lineitem GROUP BY 1, 2)"


def _heads(spark, sf):
    rows = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("pos"))
    return rows.agg((F.min("l_linenumber") % 3 + 1).cast("long").alias("level"))


@query(f"WITH {_HEADS} SELECT doc, pos, before, level FROM (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY pos) AS before FROM heads) WHERE level > before + 1")
def level_jumps(spark, sf):
    return R.level_jumps(_heads(spark, sf), ["doc"], ["pos"])


@query(f"WITH {_HEADS} SELECT h.doc, h.pos, h.level, max(b.pos) AS parent FROM heads h LEFT JOIN heads b ON b.doc = h.doc AND b.pos < h.pos AND b.level < h.level GROUP BY h.doc, h.pos, h.level")
def section_stack(spark, sf):
    return R.section_parents(_heads(spark, sf), ["doc"], "pos", deepest=4)


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_returnflag = 'R' AS entry FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - row_number() OVER (PARTITION BY doc, entry ORDER BY pos) AS g FROM f)
SELECT doc, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos, count(*) AS n_entries FROM r WHERE entry GROUP BY doc, g""")
def bibliography_fold(spark, sf):
    rows = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).agg((F.min("l_returnflag") == "R").alias("entry"))
    w = Window.partitionBy("doc")
    runs = rows.withColumn("g", F.row_number().over(w.orderBy("pos")) - F.row_number().over(Window.partitionBy("doc", "entry").orderBy("pos"))).where("entry")
    return runs.groupBy("doc", "g").agg(F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.count("*").alias("n_entries")).drop("g")


_ISSUES = f"""{D.TREE}, i AS (
  SELECT DISTINCT * FROM (
  SELECT 'duplicate id' AS rule, 'STRUCTURE' AS category, 'ERROR' AS severity, (l_orderkey * 10 + l_linenumber)::VARCHAR AS subject FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'dangling parent', 'STRUCTURE', 'ERROR', parent FROM d_tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM d_tree)
  UNION ALL SELECT 'coverage', 'COVERAGE', CASE WHEN (SELECT count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id) FROM documents d LEFT JOIN labels l USING (doc_id)) < 0.95 THEN 'ERROR' ELSE 'WARNING' END, doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'covered twice', 'COVERAGE', 'ERROR', doc_id::VARCHAR FROM labels GROUP BY doc_id HAVING count(*) > 1))"""


def _issues(spark, sf):
    items = D.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    tree = D.tree(spark, sf)
    return I.integrity([I.duplicates(items, "id", "duplicate id"), I.dangling(tree, "parent", tree, "node", "dangling parent"), I.uncovered(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id")])


@query(f"WITH {_ISSUES} SELECT *, substr(sha256(concat_ws(chr(31), rule, category, severity, subject)), 1, 32) AS issue_id FROM i")
def integrity_issues(spark, sf):
    return _issues(spark, sf)


@query(f"WITH {_ISSUES} SELECT category, severity, count(*) AS n FROM i GROUP BY category, severity")
def issue_rollup(spark, sf):
    return _issues(spark, sf).groupBy("category", "severity").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, count(*) AS n_merged, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1, 2, 3")
def relation_dedupe(spark, sf):
    return D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n_merged"), F.min("l_orderkey").alias("first_seen"))


_SPAN = """s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events)"""


@query(f"""WITH {_SPAN}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN a < reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS span_start, max(b) AS span_end, count(*) AS n FROM g GROUP BY user_id, g""")
def span_union(spark, sf):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = D.table(spark, sf, "events").select("user_id", start.alias("a"), (start + 3600).alias("b"))
    w = Window.partitionBy("user_id").orderBy("a", "b")
    rows = rows.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("g", F.sum(F.when(F.col("a") < F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "g").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"), F.count("*").alias("n")).drop("g")


_JOBS = "jobs AS (SELECT event_id AS job_id, user_id AS workspace, ts AS created, (['queued', 'running', 'completed'])[(event_id % 3 + 1)::INTEGER] AS status FROM events)"


def _jobs(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in J.STATUSES[:3]]), (F.col("event_id") % 3 + 1).cast("int"))
    return D.table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("workspace"), F.col("ts").alias("created"), status.alias("status"))


@query(f"WITH {_JOBS} SELECT workspace, job_id, row_number() OVER (PARTITION BY workspace ORDER BY created, job_id)::BIGINT AS position FROM jobs WHERE status = 'queued'")
def job_fifo(spark, sf):
    return J.claim_order(_jobs(spark, sf), "workspace").select("workspace", "job_id", "position")


@query(f"WITH {_JOBS} SELECT s.status, count(j.job_id) AS n, floor(epoch(min(j.created)))::BIGINT AS oldest FROM (VALUES ('queued'), ('running'), ('completed'), ('failed')) s(status) LEFT JOIN jobs j ON j.status = s.status GROUP BY s.status")
def job_counts(spark, sf):
    return J.status_counts(_jobs(spark, sf)).select("status", "n", F.unix_seconds(F.col("oldest").cast("timestamp")).alias("oldest"))


@query("""WITH cells AS (SELECT p_partkey AS t, (p_size % 3)::BIGINT AS r, (p_size % 4)::BIGINT AS c, (1 + p_size % 2)::BIGINT AS span, p_brand AS txt FROM part),
grid AS (SELECT t, r, unnest(range(0, 6)) AS col FROM cells)
SELECT g.t, g.r, g.col, CASE WHEN g.col = c.c THEN CASE WHEN c.span > 1 THEN '\\multicolumn{' || c.span || '}{' || c.txt || '}' ELSE c.txt END WHEN g.col > c.c AND g.col < c.c + c.span THEN '{}' ELSE '' END AS cell FROM grid g JOIN cells c ON c.t = g.t""".replace("\\\\", "\\"))
def table_grid_expand(spark, sf):
    cells = D.table(spark, sf, "part").select(F.col("p_partkey").alias("t"), (F.col("p_size") % 3).cast("long").alias("r"), (F.col("p_size") % 4).cast("long").alias("c"), (1 + F.col("p_size") % 2).cast("long").alias("span"), F.col("p_brand").alias("txt"))
    grid = cells.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    wide = F.concat(F.lit("\\multicolumn{"), F.col("span").cast("string"), F.lit("}{"), "txt", F.lit("}"))
    at = F.when(F.col("col") == F.col("c"), F.when(F.col("span") > 1, wide).otherwise(F.col("txt"))).when((F.col("col") > F.col("c")) & (F.col("col") < F.col("c") + F.col("span")), "{}").otherwise("")
    return grid.select("t", "r", "col", at.alias("cell"))


@query(f"WITH {D.TREE} SELECT node, CASE level WHEN 0 THEN 'document' WHEN 4 THEN 'paragraph' ELSE 'heading' END AS kind, CASE WHEN level BETWEEN 1 AND 3 THEN level ELSE 1 END AS level FROM d_tree")
def block_composition(spark, sf):
    level = F.col("level")
    kind = F.when(level == 0, "document").when(level == 4, "paragraph").otherwise("heading")
    return D.tree(spark, sf).select("node", kind.alias("kind"), F.when(level.between(1, 3), level).otherwise(F.lit(1).cast("long")).alias("level"))


@query(f"WITH {D.TREE} SELECT node, role FROM (SELECT node AS n, parent AS p, 'parent' AS a, 'child' AS b FROM d_tree WHERE parent IS NOT NULL), LATERAL (VALUES (n, b), (p, a)) v(node, role)")
def relation_adjacency(spark, sf):
    rows = D.tree(spark, sf).where("parent IS NOT NULL")
    both = F.array(F.struct(F.col("node").alias("node"), F.lit("child").alias("role")), F.struct(F.col("parent").alias("node"), F.lit("parent").alias("role")))
    return rows.select(F.explode(both).alias("x")).select("x.*")
