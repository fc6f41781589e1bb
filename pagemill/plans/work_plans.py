"""Queries over translation, LaTeX, workspaces, jobs and scores, on the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import jobs as J
from ..operators import latex as X
from ..operators import scoring as C
from ..operators import translate as L
from ..operators import workspace as K
from ..sources import model as M
from .registry import query
from .rule_plans import _strip

_KINDS = "('HEADING', 'PARAGRAPH', 'FIGURE_CAPTION', 'TABLE_CAPTION', 'FOOTNOTE')"
_TREE = f"{M.ctes('m_nodes')}, tr AS (SELECT n.*, coalesce(p.pos, n.pos - 1) * 1000 + n.pos AS ord FROM m_nodes n LEFT JOIN m_nodes p ON p.node = n.parent AND p.doc = n.doc)"


def _tree(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    up = nodes.select("doc", F.col("node").alias("parent"), F.col("pos").alias("_pp"))
    rows = nodes.join(up, ["doc", "parent"], "left")
    return rows.withColumn("ord", F.coalesce("_pp", F.col("pos") - 1) * 1000 + F.col("pos")).drop("_pp")


@query(f"""WITH {_TREE}, r AS (SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY ord, node) AS pos, kind, text FROM tr), t AS (SELECT *, {_strip('text')} AS s FROM r WHERE kind IN {_KINDS} AND {_strip('text')} <> '')
SELECT a.doc, a.pos, right(coalesce((SELECT string_agg(b.s, ' ' ORDER BY b.pos) FROM t b WHERE b.doc = a.doc AND b.pos < a.pos), ''), 240) AS before, left(coalesce((SELECT string_agg(b.s, ' ' ORDER BY b.pos) FROM t b WHERE b.doc = a.doc AND b.pos > a.pos), ''), 240) AS after FROM t a""")
def neighbour_context(spark, sf):
    rows = _tree(spark, sf).withColumn("pos", C.ordinal(["doc"], "ord", "node")).withColumn("level", F.lit(1))
    return L.contexts(rows).select("doc", "pos", "before", "after")


@query()
def section_paths(spark, sf):
    rows = _tree(spark, sf).withColumn("pos", C.ordinal(["doc"], "ord", "node")).withColumn("level", (1 + F.col("pos") % 3).cast("long"))
    return L.walk(rows.select("doc", "pos", "kind", "text", "level"), ["doc"], ["pos"], L.section_paths, "doc long, pos long, section_path string")


# Two marks on each text, which overlap on every third; the dummy puts 13 characters before.
_RICH = f"{M.ctes('m_regions')}, mk AS (SELECT region AS node, text, part % 3 AS k, least(part % 7, length(text) - 4) AS a, least(part % 7, length(text) - 4) + 3 AS b, CASE WHEN part % 3 = 0 THEN 2 ELSE 3 END AS off, CASE WHEN part % 2 = 0 THEN 'CITATION' ELSE 'EMPHASIS' END AS type FROM m_regions WHERE length(text) > 10)"


@query(f"WITH {_RICH} SELECT node, '[TRANSLATED] ' || text AS text, a + 13 AS start, b + 13 AS stop, type FROM mk UNION ALL SELECT node, '[TRANSLATED] ' || text, least(a + off, length(text) - 1) + 13, least(a + off + 2, length(text)) + 13, type FROM mk")
def translated_marks(spark, sf):
    p, n = F.col("part"), F.length("text")
    a = F.least(p % 7, n - 4)
    off = F.when(p % 3 == 0, 2).otherwise(3)
    kind = F.when(p % 2 == 0, "CITATION").otherwise("EMPHASIS")
    mark = lambda start, stop: F.struct(kind.alias("type"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(None).cast("long").alias("target"))
    rows = M.df(spark, sf, "m_regions").where("length(text) > 10").select(F.col("region").alias("node"), "text", F.array(mark(a, a + 3), mark(F.least(a + off, n - 1), F.least(a + off + 2, n))).alias("marks"))
    return L.translate_rich(rows).select("node", "text", F.explode("marks").alias("m")).select("node", "text", "m.start", "m.stop", "m.type")


@query(f"""WITH {M.ctes('m_nodes')}, t AS (SELECT node, NULL::BIGINT AS cell, pos, text FROM m_nodes WHERE kind IN {_KINDS} UNION ALL SELECT node, k, pos, text || ' ' || k FROM m_nodes, range(3) r(k) WHERE kind = 'TABLE')
SELECT node, cell, pos, CASE WHEN node % 4 = 0 THEN 'held ' || node || ' ' || coalesce(cell, -1) ELSE '[TRANSLATED] ' || text END AS text, node % 4 = 0 AS cached FROM t""")
def document_translation(spark, sf):
    nodes = M.df(spark, sf, "m_nodes").withColumn("context", F.lit("c")).withColumn("terminology", F.lit("rev-0"))
    cells = nodes.where("kind = 'TABLE'").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("cell"), "text").select("node", "cell", F.concat_ws(" ", "text", F.col("cell").cast("string")).alias("text"))
    none = spark.createDataFrame([], "cache_key string, cached_text string")
    first = L.translate_document(nodes, cells, none)
    held = first.where("node % 4 = 0").select("cache_key", F.concat_ws(" ", F.lit("held"), F.col("node").cast("string"), F.coalesce("cell", F.lit(-1)).cast("string")).alias("cached_text"))
    return L.translate_document(nodes, cells, held).select("node", "cell", "pos", "text", "cached")


@query(f"""WITH {M.ctes('m_nodes')}, o AS (SELECT node, pos, text AS content, 'a' AS model FROM m_nodes WHERE kind = 'PARAGRAPH' AND node % 3 <> 0), f AS (SELECT node, 'new ' || text AS content, 'b' AS model FROM m_nodes WHERE kind = 'PARAGRAPH' AND node % 2 = 0)
SELECT node, coalesce(o.pos, (SELECT max(pos) FROM o) + 1 + node) AS pos, coalesce(f.content, o.content) AS content, coalesce(f.model, o.model) AS model FROM o FULL JOIN f USING (node)""")
def layer_upsert(spark, sf):
    rows = M.df(spark, sf, "m_nodes").where("kind = 'PARAGRAPH'")
    old = rows.where("node % 3 <> 0").select("node", "pos", F.col("text").alias("content"), F.lit("a").alias("model"))
    return L.upsert(old, rows.where("node % 2 = 0").select("node", F.concat(F.lit("new "), "text").alias("content"), F.lit("b").alias("model")))


@query(f"""WITH {M.ctes('m_nodes')}, l AS (SELECT DISTINCT doc, CASE WHEN doc % 16 = 0 THEN 'gpt' WHEN doc % 24 = 0 THEN ' ' ELSE 'dummy' END AS lm FROM m_nodes), e AS (SELECT doc, CASE WHEN doc % 40 = 0 AND node % 50 = 0 THEN 'gpt' WHEN node % 3 = 0 THEN NULL ELSE 'dummy' END AS m FROM m_nodes)
SELECT l.doc, (trim(lm) NOT IN ('', 'dummy')) OR coalesce((SELECT bool_or(trim(coalesce(m, '')) NOT IN ('', 'dummy')) FROM e WHERE e.doc = l.doc), false) AS needs FROM l""")
def provider_needs(spark, sf):
    doc, node = F.col("doc"), F.col("node")
    nodes = M.df(spark, sf, "m_nodes")
    layers = nodes.select("doc").distinct().withColumn("layer_model", F.when(doc % 16 == 0, "gpt").when(doc % 24 == 0, " ").otherwise("dummy"))
    entries = nodes.select("doc", F.when((doc % 40 == 0) & (node % 50 == 0), "gpt").when(node % 3 != 0, "dummy").alias("model"))
    return L.needs_provider(layers, entries, "doc")


_OVER = f"{M.ctes('m_nodes')}, u AS (SELECT node, kind, text FROM m_nodes), en AS (SELECT node, 'T ' || text AS t FROM m_nodes WHERE kind <> 'TABLE' AND text IS NOT NULL AND node % 3 = 0), cp AS (SELECT c.node AS caption, h.node AS host FROM m_nodes c JOIN m_nodes h ON h.parent = c.parent WHERE c.kind IN ('FIGURE_CAPTION', 'TABLE_CAPTION') AND h.kind IN ('FIGURE', 'TABLE') AND h.node = c.node + 1)"


@query(f"""WITH {_OVER}, s AS (SELECT u.node, kind, coalesce(t, text) AS content FROM u LEFT JOIN en USING (node)) SELECT s.node, s.kind, s.content, cp.caption, c.content AS caption_text FROM s LEFT JOIN cp ON cp.host = s.node LEFT JOIN s c ON c.node = cp.caption WHERE s.node NOT IN (SELECT caption FROM cp)""")
def translation_overlay(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    entries = nodes.where("kind <> 'TABLE' AND text IS NOT NULL AND node % 3 = 0").select("node", F.concat(F.lit("T "), "text").alias("text"))
    hosts = nodes.where("kind IN ('FIGURE', 'TABLE')").select("parent", F.col("node").alias("host"))
    captions = nodes.where("kind IN ('FIGURE_CAPTION', 'TABLE_CAPTION')").join(hosts, "parent").where("host = node + 1").select(F.col("node").alias("caption"), "host")
    return L.overlay(nodes, entries, captions)


@query(f"""WITH {M.ctes('m_regions')}, r AS (SELECT region AS seq, 'k' || part % 40 AS key, text, CASE WHEN part % 5 = 0 THEN '0' ELSE '1' END AS v, part % 3 AS m FROM m_regions), l AS (SELECT key, max(seq) AS seq FROM r WHERE v = '1' GROUP BY key)
SELECT key AS cache_key, text, CASE WHEN m = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN m = 1 THEN 2 ELSE 0 END::BIGINT AS n_properties FROM l JOIN r USING (key, seq)""")
def cache_scan(spark, sf):
    p = F.col("part")
    mark = F.map_from_arrays(F.array(F.lit("type"), F.lit("start"), F.lit("href")), F.array(F.lit("LINK"), F.lit("1"), F.lit(None).cast("string")))
    row = F.struct(F.when(p % 5 == 0, "0").otherwise("1").alias("cacheVersion"), F.concat(F.lit("k"), (p % 40).cast("string")).alias("cacheKey"), "text", F.when(p % 3 != 0, 0.5).alias("confidence"), F.when(p % 3 == 1, F.array(mark)).alias("marks"))
    lines = M.df(spark, sf, "m_regions").select(F.col("region").alias("seq"), F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))
    return L.cache_rows(lines).select("cache_key", "text", "confidence", F.coalesce(F.size(F.try_element_at("marks", F.lit(1))), F.lit(0)).cast("long").alias("n_properties"))


@query(f"WITH {M.ctes('m_pages')}, t AS (SELECT doc, x.term, x.preferred FROM m_pages, LATERAL (VALUES ('Ring', 'anneau'), ('bolt ' || doc, 'b')) x(term, preferred) WHERE page = doc) SELECT doc AS file, term, preferred FROM t")
def glossary_scan(spark, sf):
    doc = F.col("doc").cast("string")
    json = F.concat(F.lit('[{"term":"Ring","preferredTranslation":"anneau"},{"term":"x"},3,{"term":4,"preferredTranslation":"y"},{"term":"bolt '), doc, F.lit('","preferredTranslation":"b"}]'))
    return L.glossary(M.df(spark, sf, "m_pages").where("page = doc").select(F.col("doc").alias("file"), json.alias("json"))).drop("pos")


@query(f"""WITH {M.ctes('m_regions')}, m AS (SELECT doc, lower(k) AS key, arg_max(k, region) AS term, arg_max(text, region) AS preferred FROM (SELECT doc, region, CASE WHEN n % 2 = 0 THEN 'Term' ELSE 'term' END || part % 9 AS k, text FROM m_regions WHERE part % 2 = 0) GROUP BY 1, 2),
d AS (SELECT doc, lower(k) AS key, min(k) AS term FROM (SELECT doc, 'TERM' || part % 12 AS k FROM m_regions) GROUP BY 1, 2) SELECT d.doc, coalesce(m.term, d.term) AS term, coalesce(m.preferred, '[TERM]') AS preferred, CASE WHEN m.key IS NULL THEN 'DERIVED' ELSE 'MANUAL' END AS source FROM d FULL JOIN m USING (doc, key) WHERE d.doc IS NOT NULL
UNION ALL SELECT m.doc, m.term, m.preferred, 'MANUAL' FROM m ANTI JOIN d USING (doc, key)""")
def glossary_merge(spark, sf):
    rows = M.df(spark, sf, "m_regions")
    name = F.concat(F.when(F.col("n") % 2 == 0, "Term").otherwise("term"), (F.col("part") % 9).cast("string"))
    manual = rows.where("part % 2 = 0").select("doc", F.col("region").alias("pos"), name.alias("term"), F.col("text").alias("preferred"))
    derived = rows.select("doc", F.col("region").alias("pos"), F.concat(F.lit("TERM"), (F.col("part") % 12).cast("string")).alias("term"), F.lit("[TERM]").alias("preferred"))
    return L.merged_glossary(manual, derived).select("doc", "term", "preferred", "source")


@query(f"""WITH {M.ctes('m_nodes')}, e AS (SELECT node, pos, text AS content, 'a' AS model FROM m_nodes WHERE kind = 'PARAGRAPH'), f AS (SELECT node, 'again ' || text AS content, 'b' AS model FROM m_nodes WHERE kind = 'PARAGRAPH' AND node % 9 = 0) SELECT node, e.pos, coalesce(f.content, e.content) AS content, coalesce(f.model, e.model) AS model FROM e LEFT JOIN f USING (node)""")
def rerender_subset(spark, sf):
    rows = M.df(spark, sf, "m_nodes").where("kind = 'PARAGRAPH'")
    entries = rows.select("node", "pos", F.col("text").alias("content"), F.lit("a").alias("model"))
    selected = rows.where("node % 9 = 0").select("node")
    fresh = rows.select("node", F.concat(F.lit("again "), "text").alias("content"), F.lit("b").alias("model"))
    records = spark.createDataFrame([(s, 1) for s in J.STAGES], "stage string, revision int")
    return L.rerendered(entries, selected, fresh, records)[0]


_E = "replace(replace(replace(replace(replace(replace({}, '\\', chr(1)), '{{', '\\{{'), '}}', '\\}}'), chr(1), '\\textbackslash{{}}'), '&', '\\&'), '%', '\\%')"
_E = f"replace(replace(replace(replace(replace({_E}, '$', '\\$'), '#', '\\#'), '_', '\\_'), '~', '\\textasciitilde{{{{}}}}'), '^', '\\textasciicircum{{{{}}}}')"
_A = lambda n: "'\\renderanchor{' || " + n + " || '}%' || chr(10) || "
_Z = lambda n: " || chr(10) || '\\renderanchorend{' || " + n + " || '}%'"


@query(f"""WITH {M.ctes('m_regions')}, t AS (SELECT *, {_E.format('text')} AS e FROM m_regions) SELECT region, sha256(CASE part % 3
WHEN 0 THEN {_A('region')} '\\' || (['section', 'subsection', 'subsubsection'])[(CASE WHEN n BETWEEN 1 AND 3 THEN n ELSE 1 END)::INT] || '{{' || e || '}}' {_Z('region')}
WHEN 1 THEN {_A('region')} e || chr(10) {_Z('region')}
ELSE {_A('region')} CASE WHEN n % 2 = 0 THEN '\\begin{{equation}}' || chr(10) || '\\fitmath{{x}} \\tag{{' || n || '}}' || chr(10) || '\\end{{equation}}' ELSE '\\[x\\]' END {_Z('region')} END) AS latex_sha FROM t""")
def latex_blocks(spark, sf):
    r, n, t = F.col("region"), F.col("n"), F.col("text")
    eq = X.equation(r, F.lit("x"), F.when(n % 2 == 0, n.cast("string")), F.when(n % 2 == 0, "SCALE_DOWN").otherwise("NONE"))
    block = F.when(F.col("part") % 3 == 0, X.heading(r, t, n)).when(F.col("part") % 3 == 1, X.paragraph(r, t)).otherwise(eq)
    return M.df(spark, sf, "m_regions").select("region", F.sha2(block, 256).alias("latex_sha"))


@query(f"""WITH {M.ctes('m_regions')}, t AS (SELECT *, {_E.format('text')} AS e, n % 3 <> 0 AS fl, part % 2 = 0 AS above FROM m_regions WHERE kind = 'FIGURE'), c AS (SELECT *, {_A('(region + 1)')} CASE WHEN fl THEN '\\caption' ELSE '\\captionof{{figure}}' END || '{{' || e || '}}' {_Z('(region + 1)')} AS cap,
CASE WHEN part % 5 = 0 THEN '\\fbox{{missing figure}}' ELSE '\\includegraphics[width=0.8\\textwidth]{{' || region || '.png}}' END AS img FROM t)
SELECT region, sha256(CASE WHEN fl THEN '\\begin{{figure}}[htbp]\\centering' ELSE '\\begin{{center}}' END || chr(10) || '\\renderanchor{{' || region || '}}%' || chr(10) || CASE WHEN above THEN cap || chr(10) || img ELSE img || chr(10) || cap END || chr(10) || '\\renderanchorend{{' || region || '}}%' || chr(10) || CASE WHEN fl THEN '\\end{{figure}}' ELSE '\\end{{center}}' END) AS latex_sha FROM c""")
def latex_figures(spark, sf):
    r = F.col("region")
    images = F.when(F.col("part") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(r.cast("string"), F.lit(".png"))))
    made = X.figure(r, images, r + 1, F.col("text"), F.when(F.col("part") % 2 == 0, "ABOVE").otherwise("BELOW"), F.col("n") % 3 != 0, F.lit(None).cast("string"))
    return M.df(spark, sf, "m_regions").where("kind = 'FIGURE'").select("region", F.sha2(made, 256).alias("latex_sha"))


@query()
def latex_tables(spark, sf):
    rows = M.df(spark, sf, "m_regions").select(F.col("page").alias("node"), F.lit(2).alias("n_rows"), F.lit(3).alias("n_columns"), F.expr("int(n div 3)").alias("row"), (F.col("n") % 3).cast("int").alias("col"), F.when(F.col("part") % 5 == 0, 2).otherwise(1).alias("row_span"), F.when(F.col("part") % 7 == 0, 2).otherwise(1).alias("col_span"), "text")
    return X.tabular(rows)


@query()
def math_bodies(spark, sf):
    return X.equation_bodies(M.df(spark, sf, "m_regions").select(F.col("region").alias("node"), F.when(F.col("n") == 1, " y^2 ").alias("latex"), F.col("text").alias("unicode"), F.lit("raw").alias("raw")))


@query(f"""WITH {M.ctes('m_regions')}, t AS (SELECT doc, region, {_E.format('text')} AS e, row_number() OVER (PARTITION BY doc ORDER BY region) AS i FROM m_regions WHERE page_index = 7)
SELECT doc, sha256('A' || chr(10) || '\\begin{{thebibliography}}{{99}}' || chr(10) || string_agg({_A('region')} '\\bibitem{{' || i || '}} ' || e {_Z('region')}, chr(10) ORDER BY i) || chr(10) || '\\end{{thebibliography}}' || chr(10) || 'Z') AS latex_sha FROM t GROUP BY doc""")
def latex_documents(spark, sf):
    entries = M.df(spark, sf, "m_regions").where("page_index = 7").select("doc", F.col("region").alias("pos"), F.col("region").alias("node"), "text")
    blocks = X.bibliography(entries, ["doc"]).select("doc", F.lit(0).alias("pos"), "latex")
    return X.documents(blocks, "A\n%body%\nZ", "%body%").select("doc", F.sha2("latex", 256).alias("latex_sha"))


# Workspaces: an order is a workspace, its items are artifacts of stages.
_STAGES = ", ".join(f"'{s}'" for s in J.STAGES)
_WORK = f"""{M.ctes('m_items')}, art AS (SELECT page AS workspace, ([{_STAGES}])[n::INT] AS stage, 'f' || n AS name, sha256('' || part) AS sha, n FROM m_items), rec AS (SELECT workspace, stage, n, CASE WHEN sha < '1' THEN 'degraded' ELSE 'completed' END AS status, 'v' || n % 2 AS producer_version FROM art),
fil AS (SELECT page AS workspace, 'f' || n AS name, CASE WHEN part % 10 = 0 THEN 'other' ELSE sha256('' || part) END AS now FROM m_items WHERE part % 13 <> 0), ok AS (SELECT r.workspace, r.stage, r.status = 'completed' AND coalesce(f.now = a.sha, false) AS intact FROM rec r JOIN art a USING (workspace, stage) LEFT JOIN fil f ON f.workspace = a.workspace AND f.name = a.name)"""


def _work(spark, sf):
    items = M.df(spark, sf, "m_items").withColumn("workspace", F.col("page")).withColumn("stage", F.element_at(F.array(*[F.lit(s) for s in J.STAGES]), F.col("n").cast("int"))).withColumn("name", F.concat(F.lit("f"), F.col("n").cast("string"))).withColumn("sha", F.sha2(F.col("part").cast("string"), 256))
    records = items.select("workspace", "stage", F.when(F.col("sha") < "1", "degraded").otherwise("completed").alias("status"), F.concat(F.lit("v"), (F.col("n") % 2).cast("string")).alias("producer_version"))
    files = items.where("part % 13 <> 0").select("workspace", "name", F.when(F.col("part") % 10 == 0, "other").otherwise(F.col("sha")).alias("now"))
    return records, items.select("workspace", "stage", "name", "sha"), files


@query(f"WITH {_WORK} SELECT * FROM ok")
def artifacts_intact(spark, sf):
    return K.intact(*_work(spark, sf))


@query(f"""WITH {_WORK}, up AS (SELECT r.workspace, r.stage, r.producer_version, coalesce((SELECT string_agg(a.name || '=' || a.sha, ',' ORDER BY a.name || '=' || a.sha) FROM art a WHERE a.workspace = r.workspace AND a.n < r.n), '') AS inputs, r.n FROM rec r),
fp AS (SELECT *, sha256('{{"config":"' || CASE WHEN stage = 'layout' THEN 'c1' ELSE '' END || '","inputs":"' || inputs || '","producerVersion":"' || producer_version || '"}}') AS fingerprint FROM up)
SELECT fp.workspace, fp.stage, intact AND producer_version = CASE WHEN fp.stage IN ('ingest', 'evidence', 'semantic', 'render') THEN 'v1' ELSE 'v0' END AND fp.workspace % 4 <> 0 AS current FROM fp JOIN ok USING (workspace, stage)""")
def stage_cache(spark, sf):
    records, artifacts, files = _work(spark, sf)
    config = spark.createDataFrame([("layout", "c1")], "stage string, value string")
    keys = K.fingerprints(records, artifacts, config)
    # Keys of every fourth workspace were made from other inputs.
    recorded = records.join(keys, ["workspace", "stage"]).withColumn("fingerprint", F.when(F.col("workspace") % 4 == 0, "old").otherwise(F.col("fingerprint")))
    versions = spark.createDataFrame([(s, "v1" if i % 2 == 0 else "v0") for i, s in enumerate(J.STAGES)], "stage string, version string")
    return K.current(recorded, artifacts, files, config, versions)


@query(f"WITH {_WORK} SELECT workspace, stage FROM rec WHERE n < 4")
def stage_invalidation(spark, sf):
    return K.invalidated(_work(spark, sf)[0], F.lit("layout")).select("workspace", "stage")


_JOBS = "jobs AS (SELECT lower(lpad(to_hex(event_id // 2), 32, '0')) AS job_id, (['finished', 'queued', 'running', 'lost'])[(event_id % 4 + 1)::INT] AS folder, (['succeeded', 'queued', 'running', 'failed'])[(event_id * 7 % 4 + 1)::INT] AS status, user_id AS workspace, floor(epoch(ts))::BIGINT AS created, event_id % 3 AS attempt, event_id FROM events)"


def _jobs(spark, sf):
    e = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return M.df(spark, sf, "events").select(
        F.lower(F.lpad(F.hex(F.expr("event_id div 2")), 32, "0")).alias("job_id"), pick(["finished", "queued", "running", "lost"], e % 4).alias("folder"), pick(["succeeded", "queued", "running", "failed"], e * 7 % 4).alias("status"),
        F.col("user_id").alias("workspace"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"), (e % 3).alias("attempt"), "event_id",
    )


@query(f"WITH {_JOBS}, o AS (SELECT job_id, folder, created FROM jobs WHERE folder <> 'lost' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY CASE folder WHEN 'queued' THEN 1 WHEN 'running' THEN 2 ELSE 3 END) = 1) SELECT *, row_number() OVER (ORDER BY created, job_id)::BIGINT AS position FROM o")
def job_list(spark, sf):
    return K.listed(_jobs(spark, sf))


@query(f"WITH {_JOBS} SELECT workspace, event_id::VARCHAR AS job_id, attempt, 'running' AS status FROM jobs j WHERE status = 'queued' AND workspace % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM jobs r WHERE r.workspace = j.workspace AND r.status = 'running' AND r.workspace % 3 = 0) QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY created, event_id) = 1")
def job_claims(spark, sf):
    jobs = _jobs(spark, sf).withColumn("status", F.when((F.col("status") == "running") & (F.col("workspace") % 3 != 0), "succeeded").otherwise(F.col("status"))).where("workspace % 5 <> 0")
    claimed = K.claims(jobs.withColumn("job_id", F.col("event_id")))
    return claimed.withColumn("job_id", F.col("job_id").cast("string"))


@query(f"WITH {_JOBS} SELECT event_id::VARCHAR AS job_id, workspace, attempt, 'queued' AS status FROM jobs WHERE status = 'running' AND workspace % 7 <> 0")
def job_recoveries(spark, sf):
    """Every seventh workspace is still held by a worker."""
    jobs = _jobs(spark, sf).withColumn("job_id", F.col("event_id").cast("string"))
    return K.recovered(jobs, jobs.where("workspace % 7 = 0").select("workspace"))


@query(f"WITH {_JOBS} SELECT event_id, 'queued' AS status, attempt + 1 AS attempt FROM jobs WHERE status = 'failed'")
def job_retries(spark, sf):
    jobs = _jobs(spark, sf).drop("job_id").withColumnRenamed("event_id", "job_id")
    return K.retries(jobs, jobs.where("status = 'failed'").select("job_id")).withColumnRenamed("job_id", "event_id")


@query(f"""WITH {_JOBS}, f AS (SELECT event_id AS job_id, CASE WHEN event_id % 9 < 8 THEN ([{_STAGES}])[(event_id % 9 + 1)::INT] END AS stage, 'e' || event_id AS error FROM jobs WHERE status = 'failed')
SELECT job_id, CASE WHEN stage IS NULL OR stage IN ('ingest', 'physical') THEN 'PHYSICAL_EXTRACTION' WHEN stage IN ('evidence', 'layout') THEN 'LAYOUT_REGION' WHEN stage = 'semantic' THEN 'SECTION_STRUCTURE' WHEN stage = 'translate' THEN 'TRANSLATION' WHEN stage = 'render' THEN 'RENDERING' ELSE 'RENDER_MAPPING' END AS category,
CASE WHEN stage IS NULL THEN 'FATAL' ELSE 'ERROR' END AS severity, 'pagemill.' || coalesce(stage, 'orchestrator') AS producer, error AS message, stage IS NOT NULL AS recoverable FROM f""")
def job_failures(spark, sf):
    nine = F.col("event_id") % 9
    stage = F.when(nine < 8, F.try_element_at(F.array(*[F.lit(s) for s in J.STAGES]), (nine + 1).cast("int")))
    return K.failure_issues(_jobs(spark, sf).where("status = 'failed'").select(F.col("event_id").alias("job_id"), stage.alias("stage"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error")))


@query(f"WITH {_JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, min(created) FILTER (status = 'queued') AS oldest_queued, max(created) AS last_beat, true AS alive FROM jobs")
def service_status(spark, sf):
    jobs = _jobs(spark, sf)
    now = jobs.agg((F.max("created") + 15).alias("now"))
    rows = K.status_row(jobs, jobs.select(F.col("created").alias("at")), F.lit(0))
    return rows.crossJoin(F.broadcast(now)).select("queued", "running", "failed", "oldest_queued", "last_beat", (F.col("now") - F.col("last_beat") <= J.ALIVE_SECONDS).alias("alive"))  # one row each


@query("WITH b AS (SELECT user_id, max(floor(epoch(ts)))::BIGINT AS last FROM events GROUP BY user_id), n AS (SELECT max(last) AS now FROM b) SELECT user_id, last, now - last <= 15 AS alive FROM b, n")
def heartbeat_alive(spark, sf):
    beats = M.df(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    last = beats.groupBy("user_id").agg(F.max("at").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("now")))).select("user_id", "last", (F.col("now") - F.col("last") <= J.ALIVE_SECONDS).alias("alive"))  # one row


@query(f"""WITH {M.ctes('m_pages')} SELECT page AS workspace, CASE WHEN page % 7 = 0 THEN 'refused: version' WHEN page % 5 = 0 THEN 'refused: unknown stage' WHEN page % 3 = 0 THEN 'refused: other source' ELSE 'keep' END AS action FROM m_pages""")
def source_bindings(spark, sf):
    p = F.col("page")
    rows = M.df(spark, sf, "m_pages").select(p.alias("workspace"), F.when(p % 7 == 0, "0.0.9").otherwise("0.1.0").alias("version"), F.lit("a").alias("recorded"), F.when(p % 3 == 0, "b").otherwise("a").alias("actual"), F.when(p % 5 == 0, F.array(F.lit("ingest"), F.lit("odd"))).otherwise(F.array(F.lit("ingest"))).alias("stages"))
    return K.bindings(rows)


@query(f"""WITH {M.ctes('m_pages')} SELECT 'w/' || page AS path, page::VARCHAR AS name, CASE WHEN page % 6 = 0 THEN 'unreadable' WHEN page % 4 = 1 THEN 'version' END AS error, page % 6 <> 0 AND page % 4 <> 1 AND page % 5 <> 0 AS complete, row_number() OVER (ORDER BY page // 10 DESC, page::VARCHAR, page)::BIGINT AS position FROM m_pages""")
def workspace_listing(spark, sf):
    p = F.col("page")
    done = ",".join(f'"{s}":{{"status":"completed"}}' for s in J.STAGES[1:])
    version = F.when(p % 4 == 1, "9").otherwise("0.1.0")
    good = F.concat(F.lit('{"workspaceVersion":"'), version, F.lit('","stages":{"ingest":{"status":"'), F.when(p % 5 == 0, "pending").otherwise("completed"), F.lit(f'"}},{done}}}}}'))
    one = M.df(spark, sf, "m_pages").select(F.concat(F.lit("w/"), p.cast("string")).alias("path"), F.expr("page div 10").alias("mtime"), F.when(p % 6 == 0, "{").otherwise(good).alias("json"))
    return K.discovered(one.union(one.select("path", F.col("mtime") - 5, F.lit("{"))))


@query(f"""WITH {M.ctes('m_pages')}, w AS (SELECT page, 'p' || page % 3 AS provider, 'f' || page AS fingerprint, CASE WHEN page % 4 = 0 THEN 'x/' || page END AS explicit FROM m_pages), f AS (SELECT provider, fingerprint, s AS suffix, provider || '/' || fingerprint || s AS path FROM w, (VALUES ('.xml', 2), ('.tei.xml', 3), ('.txt', 1)) v(s, k) WHERE page % v.k = 0)
SELECT provider, fingerprint, coalesce(explicit, b.path) AS path, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN b.path IS NOT NULL THEN 'folder' ELSE 'missing' END AS found FROM w LEFT JOIN (SELECT provider, fingerprint, arg_min(path, CASE suffix WHEN '.json' THEN 1 WHEN '.tei.xml' THEN 2 ELSE 3 END) AS path FROM f WHERE suffix <> '.txt' GROUP BY 1, 2) b USING (provider, fingerprint)""")
def dump_paths(spark, sf):
    p = F.col("page")
    wanted = M.df(spark, sf, "m_pages").select("page", F.concat(F.lit("p"), (p % 3).cast("string")).alias("provider"), F.concat(F.lit("f"), p.cast("string")).alias("fingerprint"), F.when(p % 4 == 0, F.concat(F.lit("x/"), p.cast("string"))).alias("explicit"))
    of = lambda s, k: wanted.where(p % k == 0).select("provider", "fingerprint", F.lit(s).alias("suffix"), F.concat("provider", F.lit("/"), "fingerprint", F.lit(s)).alias("path"))
    return K.dump_paths(wanted.drop("page"), of(".xml", 2).union(of(".tei.xml", 3)).union(of(".txt", 1)))


@query(f"WITH {M.ctes('m_pages')} SELECT page AS key, CASE WHEN page % 3 = 0 THEN 'none' WHEN page % 5 = 0 THEN 'unreadable' ELSE sha256('c' || page) END AS value FROM m_pages")
def config_digests(spark, sf):
    p = F.col("page")
    rows = M.df(spark, sf, "m_pages")
    wanted = rows.select(p.alias("key"), F.when(p % 3 != 0, p).alias("path"))
    return K.config_digests(wanted, rows.where(p % 5 != 0).select(p.alias("path"), F.concat(F.lit("c"), p.cast("string")).alias("content")))


@query(f"""WITH {M.ctes('m_regions')}, i AS (SELECT region, page, part % 4 AS k, text FROM m_regions WHERE kind = 'FIGURE') SELECT region AS resource, 'WARNING' AS severity, 'embedded image on page ' || page || ' could not be extracted (' || CASE k WHEN 0 THEN 'decode: bad' ELSE 'empty: empty image bytes' END || ')' AS message, 'empty figure box' AS fallback FROM i WHERE k < 2""")
def resource_issues(spark, sf):
    return K.resources(_images(spark, sf), R.suffix(F.col("media_type")))[1]


def _images(spark, sf):
    k = F.col("part") % 4
    return M.df(spark, sf, "m_regions").where("kind = 'FIGURE'").select(F.col("region").alias("resource"), "page", "n", F.lit("image/png").alias("media_type"), F.when(k != 1, F.col("text").cast("binary")).otherwise(F.lit("").cast("binary")).alias("content"), F.when(k == 0, "decode").alias("stage"), F.when(k == 0, "bad").alias("reason"))


@query(f"WITH {M.ctes('m_regions')} SELECT region AS resource, region || '.png' AS path, 'image/png' AS media_type, octet_length(encode(text))::BIGINT AS byte_length, sha256(text) AS sha256 FROM m_regions WHERE kind = 'FIGURE' AND part % 4 >= 2")
def resource_records(spark, sf):
    return K.resources(_images(spark, sf), R.suffix(F.col("media_type")))[0]


_SCORED = f"""{M.ctes('m_regions')}, rg AS (SELECT doc, region, region AS turn, page_index, kind, label, x, y, w, h, text FROM m_regions), tr AS (SELECT doc, region AS seq, page_index, label, x + part % 9 AS x, y, w, h FROM m_regions WHERE part % 2 = 0)"""


def _truth(spark, sf):
    regions = M.df(spark, sf, "m_regions").withColumn("turn", F.col("region"))
    geometry = F.struct((F.col("x") + F.col("part") % 9).alias("x"), "y", F.when(F.col("part") % 10 != 0, F.col("w")).alias("width"), F.col("h").alias("height"))
    row = F.struct(F.col("page_index").alias("pageIndex"), "label", F.col("text").alias("textPreview"), geometry.alias("geometry"))
    files = regions.where("part % 2 = 0").groupBy("doc").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("region", row.alias("r")))), lambda s: s["r"])).alias("json"))
    return regions, C.truth_rows(files)


@query(f"WITH {M.ctes('m_regions')}, a AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY region) - 1 AS seq, page_index, label, round(x + part % 9, 4) AS x, round(h, 4) AS h, text AS preview, part FROM m_regions WHERE part % 2 = 0) SELECT doc, seq::BIGINT AS seq, page_index, label, x, h, preview FROM a WHERE part % 10 <> 0")
def truth_rows(spark, sf):
    return _truth(spark, sf)[1].select("doc", "seq", "page_index", "label", F.round("x", 4).alias("x"), F.round("h", 4).alias("h"), "preview")


@query()
def truth_greedy(spark, sf):
    regions, truth = _truth(spark, sf)
    return C.truth_matches(truth, regions)


def _snippets(spark, sf):
    regions = M.df(spark, sf, "m_regions").withColumn("turn", F.col("region"))
    return regions, C.snippet_matches(regions.where("part % 3 = 0").select("doc", F.col("region").alias("seq"), "text"), regions.where("kind = 'TEXT'"))


@query()
def snippet_matches(spark, sf):
    return _snippets(spark, sf)[1]


@query()
def order_scores(spark, sf):
    regions, met = _snippets(spark, sf)
    flow = regions.select("doc", "region", (F.col("page_index") * 10 + F.col("n")).alias("pos"))
    return C.order_scores(met, flow, regions.where("part % 3 = 0").select("doc", F.col("region").alias("seq")), regions.where("kind = 'TEXT'"))


@query()
def label_recall(spark, sf):
    regions, truth = _truth(spark, sf)
    return C.label_recalls(truth, regions, "PARAGRAPH_LIKE")


_COVER = f"""{M.ctes('m_nodes')}, c AS (SELECT doc, kind, region IS NOT NULL AS bound, node % 3 = 0 AS rendered, pos % 3 AS n_columns, kind IN ('PARAGRAPH', 'HEADING', 'FIGURE', 'TABLE', 'EQUATION', 'FOOTNOTE', 'BIBLIOGRAPHY_ENTRY') AS a FROM m_nodes),
cov AS (SELECT doc, CASE WHEN count(*) FILTER (a) > 0 THEN round(count(*) FILTER (a AND bound) / count(*) FILTER (a), 4) ELSE 1 END::DOUBLE AS source_mapping, CASE WHEN count(*) FILTER (a) > 0 THEN round(count(*) FILTER (a AND rendered) / count(*) FILTER (a), 4) ELSE 1 END::DOUBLE AS render_mapping,
  CASE WHEN count(*) FILTER (kind = 'TABLE') > 0 THEN round(count(*) FILTER (kind = 'TABLE' AND n_columns > 1) / count(*) FILTER (kind = 'TABLE'), 4) ELSE 1 END::DOUBLE AS table_structure FROM c GROUP BY doc)"""


def _covered(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    return nodes, C.node_coverages(nodes.select("doc", "kind", F.col("region").isNotNull().alias("bound"), (F.col("node") % 3 == 0).alias("rendered"), (F.col("pos") % 3).alias("n_columns")))


@query(f"WITH {_COVER} SELECT * FROM cov")
def mapping_coverage(spark, sf):
    return _covered(spark, sf)[1]


@query(f"""WITH {M.ctes('m_nodes', 'm_regions')}, c AS{_COVER.split(', c AS', 1)[1]}, sp AS (SELECT doc, sum(length(text)) AS t, sum(CASE WHEN kind <> 'FOOTNOTE' THEN length(text) ELSE 0 END) AS own FROM m_regions GROUP BY doc),
ci AS (SELECT doc, count(*) AS m, count(*) FILTER (part % 4 = 0) AS u FROM m_regions WHERE part % 2 = 0 GROUP BY doc), ex AS (SELECT doc, avg(CASE WHEN n >= least THEN 1 ELSE 0 END) AS s FROM (SELECT d.doc, e.kind, e.least, (SELECT count(*) FROM m_nodes n WHERE n.doc = d.doc AND n.kind = e.kind) AS n FROM (SELECT DISTINCT doc FROM m_nodes) d, (VALUES ('TABLE', 2), ('FIGURE', 1), ('HEADING', 9)) e(kind, least)) GROUP BY doc)
SELECT doc, CASE WHEN t > 0 THEN round(least(own / t, 1), 4) ELSE 1 END::DOUBLE AS text_coverage, CASE WHEN m > 0 THEN round(greatest(1 - u / m, 0), 4) ELSE 1 END::DOUBLE AS citation_rate, source_mapping, render_mapping, table_structure, round(s, 4)::DOUBLE AS expectation FROM cov LEFT JOIN sp USING (doc) LEFT JOIN ci USING (doc) LEFT JOIN ex USING (doc)""")
def quality_report(spark, sf):
    nodes, covered = _covered(spark, sf)
    regions = M.df(spark, sf, "m_regions")
    marks = regions.where("part % 2 = 0")
    expected = nodes.select("doc").distinct().select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("least")) for k, n in (("TABLE", 2), ("FIGURE", 1), ("HEADING", 9))])).alias("e")).select("doc", "e.*")
    return C.report(nodes, {
        "text_coverage": (C.text_coverage(nodes, regions, regions.where("kind <> 'FOOTNOTE'")), "coverage"), "citation_rate": (C.citation_rates(nodes, marks, marks.where("part % 4 = 0")), "rate"), "source_mapping": (covered, "source_mapping"),
        "render_mapping": (covered, "render_mapping"), "table_structure": (covered, "table_structure"), "expectation": (C.expectations(nodes, nodes, expected), "score"),
    })


@query(f"WITH {M.ctes('m_regions')} SELECT region, page_index, label, round(x, 2) AS x, round(h, 2) AS h, left(text, 80) AS preview FROM m_regions WHERE part % 3 = 0 OR kind IN ('FIGURE', 'TABLE', 'FORMULA')")
def seed_truth(spark, sf):
    regions = M.df(spark, sf, "m_regions")
    return C.seed_truth(regions, regions.where("part % 3 = 0")).select("region", "page_index", "label", "x", "h", "preview")


@query(f"""WITH {M.ctes('m_items')}, b AS (SELECT page AS fixture, CASE WHEN n % 3 = 0 THEN 'blocking' ELSE 'm' || n END AS metric, CASE WHEN part % 9 = 0 THEN NULL ELSE tax END AS v, n FROM m_items WHERE page % 7 <> 1 AND n <> 6), c AS (SELECT page AS fixture, CASE WHEN n % 3 = 0 THEN 'blocking' ELSE 'm' || n END AS metric, CASE WHEN part % 11 = 0 THEN NULL ELSE tax + (part % 3 - 1) / 100.0 END::DOUBLE AS v FROM m_items WHERE page % 5 <> 0 AND n <> 6),
g AS (SELECT DISTINCT fixture FROM b WHERE fixture NOT IN (SELECT fixture FROM c)), r AS (SELECT fixture, metric, b.v AS b, c.v AS n, CASE WHEN metric = 'blocking' THEN b.v - c.v ELSE c.v - b.v END AS up, CASE WHEN metric = 'blocking' THEN 0 ELSE 0.001 END::DOUBLE AS least FROM b FULL JOIN c USING (fixture, metric) WHERE fixture NOT IN (SELECT fixture FROM g))
SELECT fixture, metric, CASE WHEN b IS NOT NULL AND n IS NULL THEN 'REGRESSED' WHEN b IS NULL AND n IS NULL THEN 'unchanged' WHEN b IS NULL OR up > least THEN 'improved' WHEN up < -least THEN 'REGRESSED' ELSE 'unchanged' END AS verdict FROM r UNION ALL SELECT fixture, 'missing', 'REGRESSED' FROM g""")
def baseline_compare(spark, sf):
    items = M.df(spark, sf, "m_items").where("n <> 6")
    metric = F.when(F.col("n") % 3 == 0, "blocking").otherwise(F.concat(F.lit("m"), F.col("n").cast("string")))
    base = items.where("page % 7 <> 1").select(F.col("page").alias("fixture"), metric.alias("metric"), F.when(F.col("part") % 9 != 0, F.col("tax")).alias("value"))
    now = items.where("page % 5 <> 0").select(F.col("page").alias("fixture"), metric.alias("metric"), F.when(F.col("part") % 11 != 0, F.col("tax") + (F.col("part") % 3 - 1) / 100).alias("value"))
    return C.compared(base, now)


@query(f"""WITH {M.ctes('m_regions')} SELECT region AS id, CASE part % 4 WHEN 0 THEN '/n' WHEN 1 THEN '/tags/1' WHEN 2 THEN '/more' END AS pointer, CASE part % 4 WHEN 0 THEN 'is not of type integer' WHEN 1 THEN 'is not of type string' WHEN 2 THEN 'is not allowed' END AS message FROM m_regions WHERE part % 4 < 3""")
def schema_validation(spark, sf):
    k = F.col("part") % 4
    json = F.concat(F.lit('{"n":'), F.when(k == 0, '"x"').otherwise("3"), F.lit(',"tags":["a"'), F.when(k == 1, ",5").otherwise(""), F.lit("]"), F.when(k == 2, ',"more":1').otherwise(""), F.lit("}"))
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"$ref": "#/defs/tag"}}}, "defs": {"tag": {"type": "string"}}}
    return C.validated(M.df(spark, sf, "m_regions").select(F.col("region").alias("id"), json.alias("json")), schema)


@query(f"WITH {M.ctes('m_nodes')} SELECT node, sha256('{{\"kind\":\"' || kind || '\",\"node\":' || node || CASE WHEN region IS NULL THEN '' ELSE ',\"region\":' || region END || '}}') AS json_sha FROM m_nodes")
def document_dump(spark, sf):
    nodes = M.df(spark, sf, "m_nodes")
    return nodes.select("node", F.struct("kind", "node", "region").alias("x")).select("node", F.sha2(F.to_json("x"), 256).alias("json_sha"))
