"""Queries over texts: citations, bibliography, terms, predicates, translation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..operators import semantics as S
from ..sources import derive as D
from .registry import query

_LIST = r"""lists AS (SELECT node, unnest(string_split_regex(regexp_extract(text, '\[\s*([0-9]{1,3}(?:\s*[,;\x{2013}-]\s*[0-9]{1,3})*)\s*\]', 1), '[,;]')) AS part FROM d_cites),
ends AS (SELECT node, trim(part, ' ') AS part, regexp_extract(part, '([0-9]+)', 1)::BIGINT AS lo, regexp_extract(part, '([0-9]+)\s*$', 1)::BIGINT AS hi FROM lists),
nums AS (SELECT DISTINCT node, unnest(CASE WHEN hi >= lo AND hi - lo <= 99 THEN range(lo, hi + 1) ELSE [lo, hi] END) AS number FROM ends)"""


def _cited(spark, sf, form: str):
    rows = D.citing(spark, sf).select(F.lit(0).alias("doc"), "node", "text")
    return S.citations(rows).where(F.col("form") == form)


def _expanded(spark, sf):
    return _cited(spark, sf, "number").select("node", F.col("key").cast("long").alias("number")).distinct()


def _labels(spark, sf):
    return D.entries(spark, sf).select("entry", T.entry_label(F.col("text")).cast("long").alias("number")).where("number IS NOT NULL")


_LABELS = r"labelled AS (SELECT entry, number::BIGINT AS number FROM (SELECT entry, regexp_extract(text, '^\s*\[([0-9]{1,3})\]\s', 1) AS number FROM d_entries) WHERE number <> '')"


@query(f"WITH {D.CITING}, {_LIST} SELECT node, number FROM nums")
def citation_expand(spark, sf):
    return _expanded(spark, sf)


@query(f"WITH {D.CITING}, {D.ENTRIES}, {_LIST}, {_LABELS} SELECT node, number, entry FROM nums JOIN labelled USING (number)")
def citation_resolve(spark, sf):
    return _expanded(spark, sf).join(_labels(spark, sf), "number").select("node", "number", "entry")


@query(f"WITH {D.CITING}, {D.ENTRIES}, {_LIST}, {_LABELS} SELECT node, number, 'CITATION_RESOLUTION' AS category, 'WARNING' AS severity FROM nums WHERE number NOT IN (SELECT number FROM labelled)")
def citation_unresolved(spark, sf):
    return _expanded(spark, sf).join(_labels(spark, sf), "number", "left_anti").select("node", "number", F.lit("CITATION_RESOLUTION").alias("category"), F.lit("WARNING").alias("severity"))


@query(f"WITH {D.CITING}, {D.ENTRIES}, {_LIST}, {_LABELS} SELECT count(*) AS n_marks, count(l.entry) AS n_resolved, CASE WHEN count(*) = 0 THEN 1 ELSE round(count(l.entry) / count(*), 6) END::DOUBLE AS rate FROM nums LEFT JOIN labelled l USING (number)")
def citation_rate(spark, sf):
    rows = _expanded(spark, sf).join(_labels(spark, sf), "number", "left")
    return rows.agg(F.count("*").alias("n_marks"), F.count("entry").alias("n_resolved"), F.when(F.count("*") == 0, 1.0).otherwise(F.round(F.count("entry") / F.count("*"), 6)).alias("rate"))


_AUTHOR = r"\(([A-Z][A-Za-z''\-]+)(?:\s+(?:et al\.|and\s+[A-Z][A-Za-z''\-]+|&\s*[A-Z][A-Za-z''\-]+))?,?\s+((?:19|20)[0-9]{2}[a-z]?)\)"


@query(f"""WITH {D.CITING}, {D.ENTRIES}, keys AS (SELECT lower(regexp_extract(text, '[A-Z][A-Za-z''\\-]+', 0)) || ':' || regexp_extract(text, '\\b((?:19|20)[0-9]{{2}}[a-z]?)\\b', 1) AS key, min(entry) AS entry FROM d_entries GROUP BY 1),
c AS (SELECT node, lower(regexp_extract(text, '{_AUTHOR}', 1)) || ':' || regexp_extract(text, '{_AUTHOR}', 2) AS key FROM d_cites) SELECT node, key, entry FROM c JOIN keys USING (key)""")
def author_year_resolve(spark, sf):
    entries = D.entries(spark, sf).select(F.lit(0).alias("doc"), F.col("entry").alias("node"), F.col("entry").alias("pos"), "text")
    return S.resolved(_cited(spark, sf, "author-year"), S.entry_keys(entries)).where("target IS NOT NULL").select("node", "key", F.col("target").alias("entry"))


# Letters and digits that are not ASCII become a digit, so that the ends of words are the same to both engines and phrases stay ASCII.
_TERM = r"\b[A-Z][a-z]+(?:[- ][A-Za-z][a-z]+\b)+"


@query(rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), plain AS (SELECT doc_id, line_no, regexp_replace(line, '[^\x00-\x7F]', '0', 'g') AS line FROM lines),
t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{_TERM}')) AS phrase, generate_subscripts(regexp_extract_all(line, '{_TERM}'), 1) - 1 AS k FROM plain),
c AS (SELECT phrase, count(*) AS n, min({{{{'d': doc_id, 'l': line_no, 'k': k}}}}) AS first FROM t WHERE length(phrase) >= 8 GROUP BY phrase ORDER BY n DESC, first, phrase LIMIT 32) SELECT phrase, n FROM c WHERE n >= 2""".replace("{{", "{").replace("}}", "}"))
def term_discovery(spark, sf):
    lines = D.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = F.regexp_replace("line", r"[^\x00-\x7F]", "0")
    # The possessive group keeps the matcher from recursing on long lines.
    found = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all(plain, F.lit(_TERM + "+"), F.lit(0))).alias("k", "phrase")).where("length(phrase) >= 8")
    # Of terms as frequent the one met first.
    counts = found.groupBy("phrase").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no", "k")).alias("first"))
    return counts.orderBy(F.desc("n"), "first", "phrase").limit(32).where("n >= 2").select("phrase", "n")


_TOK = r"list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> ''))"


@query(f"""WITH a AS (SELECT doc_id, {_TOK.format('text')} AS ta FROM documents), b AS (SELECT item_id, {_TOK.format('text')} AS tb FROM benchmark),
o AS (SELECT doc_id, item_id, len(list_intersect(ta, tb)) / least(len(ta), len(tb)) AS overlap FROM a, b WHERE len(ta) > 0 AND len(tb) > 0)
SELECT doc_id, item_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.5""")
def text_overlap(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("a"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    items = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("b"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return M.text_overlaps(docs, items).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "overlap")


@query(r"""SELECT p_partkey, p_name, CASE WHEN regexp_matches(t, '(?i)^(Figure|Fig\.)\s*[0-9]+') THEN 'FIGURE' WHEN regexp_matches(t, '(?i)^Table\s*[0-9]+') THEN 'TABLE' END AS kind
FROM (SELECT p_partkey, p_name, (['Figure ', 'Fig. ', 'TABLE ', 'Plate '])[(p_partkey % 4 + 1)::INTEGER] || p_size || ': ' || p_name AS t FROM part)""")
def caption_kinds(spark, sf):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Figure ", "Fig. ", "TABLE ", "Plate ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(lead, F.col("p_size").cast("string"), F.lit(": "), F.col("p_name"))
    return D.table(spark, sf, "part").select("p_partkey", "p_name", T.caption_kind(text).alias("kind"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'upload' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\.[^./]*$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM pages)""")
def url_slugs(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


_ESC = "plain"
for _k, _v in (("\\", "\x01"), ("{", r"\{"), ("}", r"\}"), ("\x01", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
    _ESC = f"replace({_ESC}, {'chr(1)' if _k == chr(1) else repr(_k)[:1] + _k + repr(_k)[-1:]}, {'chr(1)' if _v == chr(1) else repr(_v)[:1] + _v + repr(_v)[-1:]})"


@query(rf"""SELECT doc_id, sha256({_ESC}) AS latex_sha FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n\t]', ' ', 'g'), '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g') AS plain FROM documents)""")
def latex_escape(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(T.latex_escape(F.col("text")), 256).alias("latex_sha"))


_ID = "sha256(concat_ws(chr(31), {}))"
_IDS = _ID.format("source, 'doc', doc_id::VARCHAR")


@query(f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, {_IDS} AS h FROM documents)")
def stable_ids(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.stable_id(F.col("source"), F.lit("doc"), F.col("doc_id")).alias("id"))


@query("SELECT doc_id, sha256('[TRANSLATED] ' || text) AS content, 'dummy' AS model, substr(sha256('dummy|' || lang || '|' || text), 1, 16) AS cache_key FROM documents WHERE length(text) > 0")
def dummy_translate(spark, sf):
    docs = D.table(spark, sf, "documents").where("length(text) > 0")
    return docs.select("doc_id", F.sha2(F.concat(F.lit("[TRANSLATED] "), "text"), 256).alias("content"), F.lit("dummy").alias("model"), F.substring(F.sha2(F.concat_ws("|", F.lit("dummy"), "lang", "text"), 256), 1, 16).alias("cache_key"))


@query("""WITH m AS (SELECT DISTINCT lower(p_brand) AS k FROM part), c AS (SELECT DISTINCT p_type AS term FROM part UNION SELECT DISTINCT upper(p_brand) FROM part) SELECT term FROM c WHERE lower(term) NOT IN (SELECT k FROM m)""")
def glossary_antijoin(spark, sf):
    part = D.table(spark, sf, "part")
    manual = part.select(F.lower("p_brand").alias("k")).distinct()
    found = part.select(F.col("p_type").alias("term")).union(part.select(F.upper("p_brand"))).distinct()
    return found.join(manual, F.lower("term") == F.col("k"), "left_anti")


#: Native labels of providers and what they are called here; canonical names stand for themselves.
LABELS = {
    "para": "PARAGRAPH_LIKE", "paragraph": "PARAGRAPH_LIKE", "title": "HEADING_LIKE", "heading": "HEADING_LIKE", "section-heading": "HEADING_LIKE", "caption": "CAPTION_LIKE", "figure": "FIGURE", "image": "FIGURE",
    "table": "TABLE", "formula": "FORMULA", "equation": "FORMULA", "footnote": "FOOTNOTE", "header": "HEADER", "footer": "FOOTER", "list": "LIST", "text": "TEXT",
    "plain text": "PARAGRAPH_LIKE", "display_formula": "FORMULA", "abandon": "UNKNOWN", "discard": "UNKNOWN", "picture": "FIGURE", "list_item": "LIST", "page_header": "HEADER", "page_footer": "FOOTER", "page_number": "FOOTER",
    "section_header": "HEADING_LIKE", "document_index": "TEXT", "code": "TEXT", "reference": "TEXT", "aside_text": "TEXT", "inline_formula": "FORMULA",
}
CANONICAL = ("TEXT", "HEADING_LIKE", "PARAGRAPH_LIKE", "CAPTION_LIKE", "FIGURE", "TABLE", "FORMULA", "FOOTNOTE", "HEADER", "FOOTER", "LIST", "UNKNOWN")


def normalise_label(c):
    table = F.create_map(*[F.lit(x) for kv in {**LABELS, **{k: k for k in CANONICAL}}.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.element_at(table, F.upper(F.trim(c))), F.lit("UNKNOWN"))


@query("""SELECT tag, CASE tag WHEN 'title' THEN 'HEADING_LIKE' WHEN 'header' THEN 'HEADER' WHEN 'footer' THEN 'FOOTER' WHEN 'code' THEN 'TEXT' WHEN 'table' THEN 'TABLE' WHEN 'list' THEN 'LIST' ELSE 'UNKNOWN' END AS label, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag""")
def label_normalise(spark, sf):
    tags = D.table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).select("tag", normalise_label(F.col("tag")).alias("label"), "n")


@query(f"""WITH {D.PIECES}, n AS (SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM d_cand)
SELECT doc_id, pos, sha256(CASE WHEN regexp_matches(a, '-{{1,2}}$') AND regexp_matches(b, '^\\p{{Ll}}') THEN regexp_replace(a, '-{{1,2}}$', '') || b ELSE a || ' ' || b END) AS joined FROM (SELECT doc_id, pos, b, text || '-' AS a FROM n WHERE b <> '')""")
def hyphen_join(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = D.pieces(spark, sf).withColumn("b", F.lead("text").over(w)).where("b <> ''")
    return rows.select("doc_id", "pos", F.sha2(T.hyphen_join(F.concat("text", F.lit("-")), F.col("b")), 256).alias("joined"))
