"""A document model derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Eight orders are the pages of a document, the items of an order its objects and regions. Some references are broken on purpose,
so that integrity queries find something.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Texts of regions, by part.
_TEXTS = [
    "2 Methods", "Abstract", "References", "Figure 3. A small ring", "Table 2 shows bolts", "x = y + 1", "(12)", "We follow [1, 3-5] and x[2] here [7], see (Smith et al., 2017).",
    "as shown by (Jones & Lee, 1999b) before [9-8]", "[7] Smith, J. Rings of 2017. Town Press", "A displayed integral:", "The rings of this press are small and", "connected to every bolt of the line.", "1. first note on the page", "* second note",
    "see the note1 and bolt 2, too.", "2021-05-03", "Jane Q. Doe", "University of Rings", "Introduction", "a^2 + b_1 = c", "MULTI_COLUMN layouts", "A long meth-", "od of the ring, E = m c^2 holds.", "1.2 Related Work", "[1] Jones, A. Bolts 1999b",
]
_TEXT = "CASE part % 26 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END"

#: Table -> query; other tables, of the driver or of these, in braces.
TABLES = {
    "m_items": """SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS n, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS qty,
        min(l_discount) AS disc, min(l_tax) AS tax, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "m_pages": "SELECT o_orderkey AS page, o_orderkey - o_orderkey % 8 AS doc, o_orderkey % 8 AS page_index, o_orderstatus AS status FROM {orders}",
    "m_regions": f"""SELECT id AS region, page - page % 8 AS doc, page, page % 8 AS page_index, n, kind, CASE WHEN kind <> 'TEXT' THEN kind WHEN part % 26 IN (3, 4) THEN 'CAPTION_LIKE'
          WHEN part % 26 IN (0, 1, 2, 19, 21, 24) THEN 'HEADING_LIKE' ELSE 'PARAGRAPH_LIKE' END AS label, qty * 8 AS x, disc * 2000 + n * 40 AS y, CAST(40 + n * 10 AS DOUBLE) AS w, 20 + tax * 200 AS h,
          CAST(CASE WHEN kind = 'FOOTNOTE' THEN 8 WHEN part % 26 IN (0, 1, 2, 19, 21, 24) THEN 14 ELSE 10 END AS DOUBLE) AS font, {_TEXT} AS text, part, supp, disc, tax
        FROM (SELECT *, CASE WHEN flag = 'R' AND n > 4 THEN 'TABLE' WHEN flag = 'A' AND n > 4 THEN 'FIGURE' WHEN part % 26 IN (13, 14) THEN 'FOOTNOTE' WHEN part % 26 = 20 THEN 'FORMULA' ELSE 'TEXT' END AS kind FROM {{m_items}})""",
    # Physical objects, and the lists of them that pages hold.
    "m_objects": "SELECT id AS object, CASE WHEN id % 97 = 0 THEN -page WHEN id % 103 = 0 THEN page + 1 ELSE page END AS page FROM {m_items}",
    "m_page_objects": "SELECT page, id AS object FROM {m_items} WHERE id % 89 <> 0 UNION ALL SELECT page, id + 100000000 AS object FROM {m_items} WHERE id % 101 = 0",
    # Nodes: a root for each document, sections by page, and a node for each region.
    "m_nodes": """SELECT doc, -(doc + 1) AS node, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS pos, 'DOCUMENT' AS kind, CAST(NULL AS VARCHAR(9)) AS text, CAST(NULL AS BIGINT) AS region FROM {m_pages} WHERE page = doc
        UNION ALL SELECT doc, page * 10, -(doc + 1), page_index, CASE WHEN page % 8 = 7 THEN 'BIBLIOGRAPHY' ELSE 'SECTION' END, NULL, NULL FROM {m_pages}
        UNION ALL SELECT doc, region, CASE WHEN region % 83 = 0 THEN region + 7 ELSE page * 10 END, n, CASE WHEN kind = 'FORMULA' THEN 'EQUATION' WHEN kind <> 'TEXT' THEN kind WHEN page % 8 = 7 AND part % 26 IN (9, 25) THEN 'BIBLIOGRAPHY_ENTRY'
          WHEN part % 26 = 3 THEN 'FIGURE_CAPTION' WHEN part % 26 = 4 THEN 'TABLE_CAPTION' WHEN label = 'HEADING_LIKE' THEN 'HEADING' ELSE 'PARAGRAPH' END, text, CASE WHEN region % 79 = 0 THEN NULL WHEN region % 73 = 0 THEN -region ELSE region END FROM {m_regions}""",
    "m_children": """SELECT parent, node AS child, pos FROM {m_nodes} WHERE parent IS NOT NULL AND node % 71 <> 0 UNION ALL SELECT parent, node, pos + 100 FROM {m_nodes} WHERE node % 67 = 0 AND parent IS NOT NULL
        UNION ALL SELECT parent, node + 500000000, pos + 200 FROM {m_nodes} WHERE node % 61 = 0 AND parent IS NOT NULL UNION ALL SELECT parent - 10, node, pos + 300 FROM {m_nodes} WHERE node % 59 = 0 AND parent > 10""",
    "m_relations": """SELECT doc, node AS source, CASE WHEN node % 7 = 0 THEN node + 300000000 WHEN node % 5 = 0 THEN node ELSE node + 1 END AS target, CASE kind WHEN 'FIGURE_CAPTION' THEN 'CAPTION_OF' WHEN 'TABLE_CAPTION' THEN 'CAPTION_OF' WHEN 'PARAGRAPH' THEN 'CITES' ELSE 'FOOTNOTE_OF' END AS type
        FROM {m_nodes} WHERE kind IN ('FIGURE_CAPTION', 'TABLE_CAPTION', 'PARAGRAPH', 'FOOTNOTE') AND node % 2 = 0""",
    # Layout: a band for each half of a page, columns in it, groups of captions.
    "m_bands": "SELECT page * 2 + b AS band, CASE WHEN page % 29 = 0 THEN page + 3 ELSE page END AS page, page AS own FROM {m_pages} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS b UNION ALL SELECT 1) halves",
    "m_columns": "SELECT band * 2 + c AS col, CASE WHEN band % 31 = 0 THEN own + 1 ELSE own END AS page, CASE WHEN band % 37 = 0 THEN band + 900000000 ELSE band END AS band, band AS own FROM {m_bands} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS c UNION ALL SELECT 1) sides",
}


def _depends(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", TABLES[name])


def df(spark: SparkSession, sf: str, name: str, **given: DataFrame) -> DataFrame:
    """A table; those given stand for tables of their name."""
    if name in given:
        return given[name]
    if name not in TABLES:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.sql(TABLES[name], **{d: df(spark, sf, d, **given) for d in set(_depends(name))})


def ctes(*names: str) -> str:
    """The tables as common table expressions for an oracle, those they read first."""
    out: dict[str, str] = {}

    def put(name: str) -> None:
        for d in _depends(name):
            if d in TABLES:
                put(d)
        out.setdefault(name, f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', TABLES[name])})")

    for n in names:
        put(n)
    return ", ".join(out.values())
