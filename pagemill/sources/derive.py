"""Document tables derived from the driver's tables: as DataFrames, and as the same views in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_HEIGHT, PAGE_WIDTH = 600.0, 560.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span for each line: 40 lines a page, a wider gap after each fifth."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    on_page = F.col("line_no") % 40
    return rows.select(
        "doc_id",
        F.expr("line_no div 40").cast("long").alias("page"),
        F.col("line_no").cast("long").alias("line_no"),
        "text",
        ((F.col("doc_id") % 2) * 20).cast("double").alias("x"),
        (on_page * 12 + F.floor(on_page / 5) * 15).cast("double").alias("y"),
        (F.least(F.length("text"), F.lit(100)) * 5).cast("double").alias("w"),
        F.lit(10.0).alias("h"),
        F.when(F.col("line_no") == 0, 14.0).otherwise(10.0).alias("font"),
    )


SPANS = """d_spans AS (
  SELECT doc_id, line_no // 40 AS page, line_no, text, ((doc_id % 2) * 20)::DOUBLE AS x, ((line_no % 40) * 12 + ((line_no % 40) // 5) * 15)::DOUBLE AS y,
         (least(length(text), 100) * 5)::DOUBLE AS w, 10::DOUBLE AS h, CASE WHEN line_no = 0 THEN 14 ELSE 10 END::DOUBLE AS font
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS line_no FROM documents))"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each line item on its order's page; box_id counts within the page."""
    rows = table(spark, sf, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return rows.withColumn("n", F.row_number().over(own)).select(
        F.col("l_orderkey").alias("page"),
        F.col("n").cast("long").alias("box_id"),
        (F.col("l_quantity") * 8).alias("x"),
        (F.col("l_discount") * 2000).alias("y"),
        (F.lit(40) + F.col("l_linenumber") * 10).cast("double").alias("w"),
        (F.lit(20) + F.col("l_tax") * 200).alias("h"),
        F.when(F.col("l_returnflag") == "R", "TABLE").when(F.col("l_returnflag") == "A", "FIGURE").otherwise("TEXT").alias("label"),
        (F.lit(0.5) + F.col("l_tax") * 5).alias("confidence"),
        F.col("l_linestatus").alias("provider"),
    )


BOXES = """d_boxes AS (
  SELECT l_orderkey AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))::BIGINT AS box_id,
         l_quantity * 8 AS x, l_discount * 2000 AS y, (40 + l_linenumber * 10)::DOUBLE AS w, 20::DOUBLE + l_tax * 200 AS h,
         CASE l_returnflag WHEN 'R' THEN 'TABLE' WHEN 'A' THEN 'FIGURE' ELSE 'TEXT' END AS label, 0.5::DOUBLE + l_tax * 5 AS confidence, l_linestatus AS provider
  FROM lineitem)"""


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into pieces of 200 characters, in order."""
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = table(spark, sf, "documents").where("length(text) > 0")
    return rows.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit("(?s).{1,200}"), F.lit(0))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


PIECES = """d_cand AS (
  SELECT doc_id, pos, substr(t, pos * 200 + 1, 200) AS text
  FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t, unnest(range(0, (length(text) + 199) // 200)) AS pos FROM documents WHERE length(text) > 0))"""


def citing(spark: SparkSession, sf: str) -> DataFrame:
    """A citing text for each order."""
    o = F.col("o_orderkey")
    body = F.concat(F.lit("see ["), (o % 150).cast("string"), F.lit("-"), (o % 150 + o % 4).cast("string"), F.lit(", "), (o % 97).cast("string"), F.lit("] and (Part"), F.chr((F.col("o_custkey") % 26) + 97), F.lit(" et al., "), F.year("o_orderdate").cast("string"), F.lit(")"))
    return table(spark, sf, "orders").select(o.alias("node"), body.alias("text"))


CITING = """d_cites AS (
  SELECT o_orderkey AS node, 'see [' || (o_orderkey % 150) || '-' || (o_orderkey % 150 + o_orderkey % 4) || ', ' || (o_orderkey % 97) || '] and (Part' || chr((o_custkey % 26 + 97)::INTEGER) || ' et al., ' || year(o_orderdate) || ')' AS text
  FROM orders)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Bibliography entries with an author, a year and, but for small parts, a label in brackets."""
    p = F.col("p_partkey")
    label = F.when(F.col("p_size") > 5, F.concat(F.lit("["), p.cast("string"), F.lit("] "))).otherwise("")
    text = F.concat(label, F.lit("Part"), F.chr((p % 26) + 97), F.lit(" "), F.col("p_name"), F.lit(" "), (F.lit(1992) + p % 7).cast("string"))
    return table(spark, sf, "part").select(p.alias("entry"), text.alias("text"))


ENTRIES = """d_entries AS (
  SELECT p_partkey AS entry, CASE WHEN p_size > 5 THEN '[' || p_partkey || '] ' ELSE '' END || 'Part' || chr((p_partkey % 26 + 97)::INTEGER) || ' ' || p_name || ' ' || (1992 + p_partkey % 7) AS text FROM part)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """root > regions > nations > customers; customers of every 50th key hang on a missing parent."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("level"))
    a = region.select(s("r", "r_regionkey"), F.lit("root"), F.col("r_regionkey").cast("long"), F.lit(1).cast("long"))
    b = nation.select(s("n", "n_nationkey"), s("r", "n_regionkey"), F.col("n_nationkey").cast("long"), F.lit(2).cast("long"))
    c = customer.select(s("c", "c_custkey"), F.when(F.col("c_custkey") % 50 == 0, s("x", "c_nationkey")).otherwise(s("n", "c_nationkey")), F.col("c_custkey").cast("long"), (F.lit(3) + F.col("c_custkey") % 2).cast("long"))
    return root.union(a).union(b).union(c)


TREE = """d_tree AS (
  SELECT 'root' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS pos, 0::BIGINT AS level
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey, 1 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 2 FROM nation
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE 'n' END || c_nationkey, c_custkey, 3 + c_custkey % 2 FROM customer)"""
