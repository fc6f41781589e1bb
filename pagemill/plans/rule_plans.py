"""Queries over rules of single texts, and over citations and notes, on the derived document model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import semantics as S
from ..sources import model as M
from .registry import query

_WS = R.SPACE
_Q = lambda p: p.replace("'", "''")


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _count(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, '{chars}', '')))"


def _density(c: str) -> str:
    bare = f"regexp_replace({c}, '{_WS}', '', 'g')"
    return f"CASE WHEN length({bare}) > 0 THEN {_count(bare, R.MATH_CHARS)} / length({bare}) ELSE 0 END"


_S = f"{M.ctes('m_regions')}, s AS (SELECT *, {_strip('text')} AS s FROM m_regions)"


@query(f"""WITH {_S}, d AS (SELECT *, {_density('s')} AS density FROM s)
SELECT region, round(density, 6)::DOUBLE AS density, length(s) BETWEEN 1 AND 80 AND NOT regexp_matches(s, '[:;]$') AND NOT regexp_matches(s, '[A-Za-z]{{4,}}') AND density >= 0.3::DOUBLE AS display,
  length(s) BETWEEN 1 AND 30 AND regexp_matches(s, '[=^_]') AND density >= 0.5::DOUBLE AS strong, CASE WHEN regexp_matches(s, '^\\(\\p{{Nd}}{{1,3}}\\)$') THEN substr(s, 2, length(s) - 2) END AS number,
  text <> '' AND length(text) <= 200 AND {_count('s', '=' + chr(92))} > 0 AND {_count('s', R.FORMULA_CHARS)} >= 0.15::DOUBLE * length(s) AS formula FROM d""")
def equation_predicates(spark, sf):
    t = F.col("text")
    return M.df(spark, sf, "m_regions").select("region", F.round(R.math_density(R.strip(t)), 6).alias("density"), R.is_display(t).alias("display"), R.is_strong_math(t).alias("strong"), R.equation_number(t).alias("number"), R.looks_like_formula(t).alias("formula"))


_HEAD = f"""u AS (SELECT *, regexp_extract(s, '{R.NUMBERED}', 1) AS num, {_strip(f"substr(s, length(regexp_extract(s, '{R.NUMBERED}', 0)) + 1)")} AS rest FROM s),
h AS (SELECT *, num <> '' AND regexp_matches(rest, '^\\p{{L}}') AS numbered, regexp_matches(s, '{R.BIBLIOGRAPHY}') OR regexp_matches(s, '{R.ABSTRACT}') OR (label = 'HEADING_LIKE' AND NOT regexp_matches(s, '[:;]$|[()=+_\\\\^]') AND regexp_matches(s, '[A-Za-z]{{4,}}') AND regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9 .,;:''\\-]*$')) AS named FROM u),
heads AS (SELECT *, CASE WHEN numbered THEN length(num) - length(replace(num, '.', '')) + 1 ELSE 1 END::BIGINT AS level, CASE WHEN numbered THEN num END AS numbering FROM h WHERE s <> '' AND length(s) <= 80 AND NOT regexp_matches(s, '[=^_\\\\]') AND (numbered OR named))"""


@query(f"WITH {_S}, {_HEAD} SELECT region, level, numbering FROM heads")
def heading_levels(spark, sf):
    return S.with_heading(M.df(spark, sf, "m_regions")).where("level IS NOT NULL").select("region", "level", "numbering")


_FRONT = f"NOT regexp_matches(s, '{R.BODY_HEADING}') AND (regexp_matches(s, '{R.DATE_LINE}') OR regexp_matches(s, '{R.AFFILIATION}') OR (regexp_matches(s, '{R.AUTHOR_LINE}') AND len(string_split_regex(s, '{_WS}+')) <= 6))"


@query(f"WITH {_S} SELECT region, {_FRONT} AS front_line, length(s) >= 40 AND regexp_matches(s, '[.!?:]$') AS sentence, regexp_matches(s, '{R.BODY_HEADING}') AS body_heading, regexp_matches(s, '{R.BIBLIOGRAPHY}') AS bibliography FROM s")
def front_lines(spark, sf):
    s = R.strip(F.col("text"))
    return M.df(spark, sf, "m_regions").select("region", R.is_front_line(s).alias("front_line"), R.is_body_sentence(s).alias("sentence"), s.rlike(R.BODY_HEADING).alias("body_heading"), s.rlike(R.BIBLIOGRAPHY).alias("bibliography"))


@query(f"""WITH {_S} SELECT region, length(s) BETWEEN 1 AND 120 AND NOT regexp_matches(s, '{R.ABSTRACT_HEAD}') AND NOT regexp_matches(s, '{R.SECTION_HEAD}') AND font <= 10 * 1.15 AND (contains(s, ',') OR contains(s, ' and ') OR regexp_matches(s, '{_Q(R.AUTHOR_MARK)}')) AS author_line,
CASE WHEN regexp_matches(s, '{R.ABSTRACT_HEAD}') AND length(s) < 40 THEN 'ABSTRACT' WHEN regexp_matches(s, '{R.REFERENCES_HEAD}') AND length(s) < 40 THEN 'REFERENCES' WHEN regexp_matches(s, '{R.SECTION_HEAD}') AND length(s) <= 120 THEN 'SECTION' END AS role FROM s""")
def structure_roles(spark, sf):
    t = F.col("text")
    return M.df(spark, sf, "m_regions").select("region", R.is_author_line(t, F.col("font"), F.lit(10.0)).alias("author_line"), R.structure_role(R.strip(t)).alias("role"))


@query(f"""WITH {_S} SELECT region, font >= 11.5 AND NOT contains(text, '=') AND length(text) <= 120 AND n <= 2 AS heading_like, kind = 'TEXT' AND (label = 'CAPTION_LIKE' OR regexp_matches(s, '(?i)^(Figure|Fig\\.)\\s*[0-9]+') OR regexp_matches(s, '(?i)^Table\\s*[0-9]+')) AS caption,
(CASE WHEN kind = 'FOOTNOTE' THEN 'TEXT' ELSE kind END) = 'TEXT' AND label NOT IN ('HEADING_LIKE', 'CAPTION_LIKE') AND y >= 0.72::DOUBLE * 200 AND font <= 9.5 AND regexp_matches(s, '{R.NOTE_MARKER}') AS note,
CASE WHEN regexp_matches(s, '{R.NOTE_MARKER}') THEN coalesce(nullif(regexp_extract(s, '^(\\p{{Nd}}{{1,2}})(?:\\.|\\s)', 1), ''), nullif(regexp_extract(s, '^([*†‡§¶])', 1), '')) END AS note_label,
nullif(regexp_replace(regexp_extract(text, '{R.FIGURE_LABEL}', 1), '\\.+$', ''), '') AS figure_label, lower({_strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")}) AS match_text FROM s""")
def region_predicates(spark, sf):
    from ..functions import text as T

    t, label = F.col("text"), F.col("label")
    kind = F.when(F.col("kind") == "FOOTNOTE", "TEXT").otherwise(F.col("kind"))
    return M.df(spark, sf, "m_regions").select(
        "region", R.is_heading_like(t, F.col("font"), F.lit(10.0), F.col("n")).alias("heading_like"), ((F.col("kind") == "TEXT") & ((label == "CAPTION_LIKE") | T.caption_kind(R.strip(t)).isNotNull())).alias("caption"),
        R.is_footnote(kind, label, t, F.col("y"), F.col("font"), F.lit(200.0), F.lit(10.0)).alias("note"), R.note_label(t).alias("note_label"), R.figure_label(t).alias("figure_label"), R.collapse(t).alias("match_text"),
    )


def _spans(table: str, pattern: str, key: str = "region", more: str = "") -> str:
    """Spans of a pattern with one group, by marks put around the matches."""
    return f"""(SELECT {key}{more}, split_part(p[i], chr(2), 1) AS match, (length(array_to_string(p[1:i - 1], '')) - (i - 2))::BIGINT AS start, text FROM (
  SELECT {key}{more}, text, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(text, '{_Q(pattern)}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM {table})))"""


_CIT = r"(\[\s*\p{Nd}{1,3}(?:\s*[,;\x{2013}-]\s*\p{Nd}{1,3})*\s*\])"
_AY = r"(\([A-Z][A-Za-z'\-]+(?:\s+(?:et al\.|and\s+[A-Z][A-Za-z'\-]+|&\s*[A-Z][A-Za-z'\-]+))?,?\s+(?:19|20)\p{Nd}{2}[a-z]?\))"
_CITED = f"""{M.ctes('m_regions')}, body AS (SELECT * FROM m_regions WHERE kind = 'TEXT' AND page_index <> 7), ns AS (SELECT * FROM {_spans('body', _CIT, 'doc, region')} WHERE start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}]')),
toks AS (SELECT *, unnest(string_split_regex(regexp_replace(match, '[\\[\\]\\s]', '', 'g'), '[,;]')) AS tok FROM ns), ends AS (SELECT *, string_split_regex(tok, '[\\x{{2013}}-]') AS e FROM toks),
nums AS (SELECT DISTINCT doc, region, start, start + length(match) AS stop, unnest(CASE WHEN len(e) = 1 THEN e WHEN len(e) = 2 AND e[1]::INT <= e[2]::INT AND e[2]::INT - e[1]::INT <= 99 THEN [x::VARCHAR FOR x IN range(e[1]::INT, e[2]::INT + 1)] WHEN len(e) = 2 THEN e ELSE [] END) AS key, 'number' AS form FROM ends),
ays AS (SELECT * FROM {_spans('body', _AY, 'doc, region')} WHERE start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}]')),
cited AS (SELECT doc, region, start, stop, key, form FROM nums UNION ALL SELECT doc, region, start, start + length(match), lower(regexp_extract(match, '{_Q(R.AUTHOR_YEAR)}', 1)) || ':' || regexp_extract(match, '{_Q(R.AUTHOR_YEAR)}', 2), 'author-year' FROM ays),
ent AS (SELECT doc, region, n + page_index * 10 AS pos, text, regexp_replace(text, '{R.ENTRY_LABEL}', '') AS rest FROM m_regions WHERE page_index = 7 AND regexp_matches(text, '{R.ENTRY_LABEL}')),
keys AS (SELECT doc, key, form, arg_min(region, pos) AS target FROM (SELECT doc, region, pos, regexp_extract(text, '{R.ENTRY_LABEL}', 1) AS key, 'number' AS form FROM ent
  UNION ALL SELECT doc, region, pos, lower(regexp_extract(rest, '[A-Z][A-Za-z''\\-]+', 0)) || ':' || regexp_extract(rest, '\\b((?:19|20)\\p{{Nd}}{{2}}[a-z]?)\\b', 1), 'author-year' FROM ent WHERE regexp_matches(rest, '[A-Z][A-Za-z''\\-]+') AND regexp_matches(rest, '\\b(?:19|20)\\p{{Nd}}{{2}}[a-z]?\\b')) GROUP BY doc, key, form)"""


def _cited(spark, sf):
    regions = M.df(spark, sf, "m_regions").withColumn("node", F.col("region"))
    body, last = regions.where("kind = 'TEXT' AND page_index <> 7"), regions.where("page_index = 7").withColumn("pos", F.col("n") + F.col("page_index") * 10)
    return S.citations(body), S.entry_keys(last.where(F.regexp_extract("text", R.ENTRY_LABEL, 1) != ""))


@query(f"WITH {_CITED} SELECT region AS node, start, stop, key, form FROM cited")
def citation_spans(spark, sf):
    return _cited(spark, sf)[0].drop("doc")


@query(f"WITH {_CITED} SELECT c.region AS node, c.start, c.key, c.form, k.target FROM cited c JOIN keys k USING (doc, key, form)")
def citation_targets(spark, sf):
    return S.resolved(*_cited(spark, sf)).where("target IS NOT NULL").select("node", "start", "key", "form", "target")


@query(f"WITH {_CITED} SELECT DISTINCT c.region AS node, c.key, 'CITATION_RESOLUTION' AS category, 'unresolved ' || c.form || ' citation ' || c.key AS message FROM cited c LEFT JOIN keys k USING (doc, key, form) WHERE k.target IS NULL")
def citation_issues(spark, sf):
    rows = S.resolved(*_cited(spark, sf)).where("target IS NULL")
    return rows.select("node", "key", F.lit("CITATION_RESOLUTION").alias("category"), F.concat(F.lit("unresolved "), "form", F.lit(" citation "), "key").alias("message")).distinct()


@query(f"WITH {_CITED} SELECT c.region AS source, k.target, 'CITES' AS type, count(*) AS n_marks FROM cited c JOIN keys k USING (doc, key, form) GROUP BY 1, 2")
def citation_relations(spark, sf):
    rows = S.resolved(*_cited(spark, sf)).where("target IS NOT NULL")
    return rows.groupBy(F.col("node").alias("source"), "target").agg(F.lit("CITES").alias("type"), F.count("*").alias("n_marks"))


# A number or sign with what follows it, which RE2 cannot look ahead to; no such sign is a marker itself.
_NOTES = f"""{M.ctes('m_regions')}, para AS (SELECT * FROM m_regions WHERE kind = 'TEXT'), marked AS (SELECT *, string_split(regexp_replace(text, '(\\p{{Nd}}{{1,2}}|[*†‡§¶])([\\s.,;:!?)]|$)', chr(1) || '\\1' || chr(2) || '\\2', 'g'), chr(1)) AS p FROM para),
refs AS (SELECT doc, page, region, text, split_part(p[i], chr(2), 1) AS label, (length(array_to_string(p[1:i - 1], '')) - (i - 2))::BIGINT AS start FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM marked)),
ok AS (SELECT *, substr(text, 1, start) AS prefix, regexp_replace(substr(text, 1, start), '{_WS}+$', '') AS bare FROM refs WHERE NOT (start > 0 AND regexp_matches(label, '^\\p{{Nd}}+$') AND regexp_matches(substr(text, start, 1), '\\p{{Nd}}'))),
scored AS (SELECT *, CASE WHEN regexp_matches(label, '^\\p{{Nd}}+$') AND regexp_matches(bare, '{R.STRUCTURAL}') THEN 0 WHEN regexp_matches(prefix, '\\p{{L}}$') THEN 0.95 WHEN regexp_matches(prefix, '{_WS}$') AND regexp_matches(bare, '\\p{{L}}$') THEN 0.7 WHEN regexp_matches(prefix, '[.,;:!?]$') THEN 0.4 ELSE 0.35 END::DOUBLE AS score FROM ok),
notes AS (SELECT * FROM (SELECT region AS note, page, {_strip('text')} AS s FROM m_regions WHERE kind = 'FOOTNOTE') ), labelled AS (SELECT note, page, coalesce(nullif(regexp_extract(s, '^(\\p{{Nd}}{{1,2}})(?:\\.|\\s)', 1), ''), regexp_extract(s, '^([*†‡§¶])', 1)) AS label FROM notes)"""


def _notes(spark, sf):
    regions = M.df(spark, sf, "m_regions").withColumn("node", F.col("region"))
    notes = regions.where("kind = 'FOOTNOTE'").select("doc", F.col("region").alias("note"), R.note_label(F.col("text")).alias("label"), "page", (F.col("page_index") * 10 + F.col("n")).alias("pos"))
    text = regions.where("kind = 'TEXT'")
    return notes, S.note_candidates(text, text.select("node", "page"), notes)


@query(f"WITH {_NOTES} SELECT n.note, s.region AS node, s.label, s.start, s.score FROM scored s JOIN labelled n ON n.page = s.page AND n.label = s.label WHERE s.score > 0")
def note_references(spark, sf):
    return _notes(spark, sf)[1].select("note", "node", "label", "start", "score")


@query()
def note_links(spark, sf):
    notes, found = _notes(spark, sf)
    return S.assign_notes(notes, found)


@query(f"""WITH {M.ctes('m_regions')}, c AS (SELECT region, CASE part % 4 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS media, CASE part % 4 WHEN 0 THEN 'FFD8FF00' WHEN 1 THEN '89504E470D0A1A0A01' WHEN 2 THEN '524946460000000057454250' ELSE '00FF' END AS head FROM m_regions WHERE kind = 'FIGURE')
SELECT region, CASE lower(media) WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' WHEN 'application/pdf' THEN '.pdf' ELSE '.bin' END AS suffix, CASE WHEN starts_with(head, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(head, '89504E47') THEN 'image/png' WHEN starts_with(head, '52494646') THEN 'image/webp' ELSE 'application/octet-stream' END AS media_type FROM c""")
def media_types(spark, sf):
    four = F.col("part") % 4
    media = F.when(four == 0, "image/PNG").when(four == 1, "image/jpeg").when(four == 2, "application/pdf").otherwise("text/plain")
    head = F.when(four == 0, "FFD8FF00").when(four == 1, "89504E470D0A1A0A01").when(four == 2, "524946460000000057454250").otherwise("00FF")
    return M.df(spark, sf, "m_regions").where("kind = 'FIGURE'").select("region", R.suffix(media).alias("suffix"), R.media_type(F.unhex(head)).alias("media_type"))
