"""Tool-call linking: results to their calls, an order that respects dependence, checked arguments, canonical JSON.

link() hash-joins calls and results by identifier, numbers the calls by layers (a call stands above all it depends on),
checks arguments against schemas, and writes one JSON text for each call with sorted keys and no blanks.

Layers. Calls that depend on exactly one other are chains; doubling the reach of their pointers takes them to the
call their chain starts from in as many rounds as the longest chain has binary digits. What is left are
calls that depend on several: these are settled from the bottom up, a round for each layer of such calls. Each
round is one staged table, so neither the plan nor the driver grows with the depth.

Schemas list fields by path: `a`, `a.b` in an object, `a[]` for the items of an array, `a[].b`. Each has a type, whether it
is required (in every object that holds it) and, optionally, the JSON texts it may have. An object of which fields
are listed may have no others. Paths are looked at to the depth that is asked for.

Status of a call: `ok`, `no result`, or `cycle` (it depends on itself through others, or on such a call; its layer is
null); a result without its call is a row of status `no call`. Several different results of a call give a row
each. Dependences on calls that do not exist are ignored. Null, invalid or non-object arguments are an error
and stand as null in the JSON; a null name is an unknown tool and null in the JSON. Rows that repeat a call_id count once (the
smallest by name, then arguments, then dependences), so ties are settled alike at any partitioning. Texts are taken whole at
any length. Columns other than the named ones are ignored. Empty tables give an empty one. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, new_path, stage, table

#: Types of a schema, and what schema_of_variant says of their values.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}
#: Tools of the derived calls: fields by name, type and whether they are required.
TOOLS = {
    "answer": [("chars", "integer", True), ("prompt", "string", True), ("turn", "integer", False)],
    "lookup": [("chars", "number", True), ("language", "string", False), ("prompt", "string", True), ("turn", "string", True)],
    "outline": [("chars", "integer", True), ("prompt", "string", True), ("sections", "integer", True), ("turn", "integer", True)],
}


def schemas(spark: SparkSession, tools: dict = TOOLS) -> DataFrame:
    """Name and fields (path, type, required, and the JSON texts allowed, or null) of each tool."""
    rows = [(n, [(*f, None) if len(f) == 3 else tuple(f) for f in fields]) for n, fields in tools.items()]
    return spark.createDataFrame(rows, "name string, fields array<struct<field:string,type:string,required:boolean,allowed:array<string>>>")


def _chains(one: DataFrame) -> DataFrame:
    """Of calls with one dependence (call_id, on): call_id, to, dist of the first call down their chain that is none of these; no row for calls that end in a cycle."""
    ids = one.select(F.col("call_id").alias("to"), F.lit(True).alias("open"))
    current = stage(one.select("call_id", F.col("on").alias("to"), F.lit(1).cast("long").alias("dist")).join(ids, "to", "left").select("call_id", "to", "dist", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    # Reach doubles with each round; what is still open when it exceeds the number of calls goes round in a cycle.
    for _ in range(current.count().bit_length() + 1):
        if current.where("open").isEmpty():
            break
        ahead = current.select(F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        jumped = current.where("open").join(ahead, "to").select("call_id", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_open").alias("open"))
        after = stage(current.where("NOT open").union(jumped), "chains")
        drop(current)
        current = after
    return current.where("NOT open").drop("open")


def _settled(hard: DataFrame, bottom: DataFrame) -> DataFrame | None:
    """call_id and layer of calls with several dependences: hard has call_id, to and dist (to is null in a cycle), bottom the calls of layer 0."""
    spark, base, number = hard.sparkSession, new_path(hard.sparkSession, "settled"), 0
    needs = hard.groupBy("call_id").agg(F.count("*").alias("needs"))
    last, rest = bottom, None
    while not last.isEmpty():
        new = hard.join(last.select(F.col("call_id").alias("to"), F.col("layer").alias("_layer")), "to").select("call_id", F.lit(1).cast("long").alias("met"), (F.col("_layer") + F.col("dist")).alias("layer"))
        new = new if rest is None else new.union(rest.select("call_id", "met", "layer"))
        state = new.groupBy("call_id").agg(F.sum("met").alias("met"), F.max("layer").alias("layer")).join(needs, "call_id")
        state.write.option("compression", "zstd").parquet(f"{base}/round={number}")
        state = spark.read.schema(state.schema).parquet(f"{base}/round={number}")
        last, rest = state.where("met = needs"), state.where("met < needs")
        number += 1
    return spark.read.parquet(base).where("met = needs").select("call_id", "layer") if number else None


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, layer): 0 for calls that depend on none, else one more than the highest they depend on; no row for calls on cycles or above them."""
    ids = nodes.select("call_id")
    edges = stage(edges.join(ids, "call_id", "left_semi").join(ids.withColumnRenamed("call_id", "on"), "on", "left_semi").select("call_id", "on").distinct(), "edges")
    needs = edges.groupBy("call_id").agg(F.count("*").alias("needs"), F.min("on").alias("on"))
    bottom = stage(ids.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("layer")), "bottom")
    chains = _chains(needs.where("needs = 1").select("call_id", "on"))
    several = edges.join(needs.where("needs > 1").select("call_id"), "call_id", "left_semi")
    single = needs.where("needs = 1").select(F.col("call_id").alias("on"), F.lit(True).alias("_single"))
    ends = several.join(single, "on", "left").join(chains.select(F.col("call_id").alias("on"), "to", "dist"), "on", "left")
    to = F.when(F.col("_single").isNull(), F.col("on")).otherwise(F.col("to"))
    hard = stage(ends.select("call_id", to.alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")).groupBy("call_id", "to").agg(F.max("dist").alias("dist")), "hard")
    starts = bottom
    if not hard.isEmpty() and (settled := _settled(hard, bottom)) is not None:
        starts = bottom.union(settled)
    above = chains.join(starts.select(F.col("call_id").alias("to"), "layer"), "to").select("call_id", (F.col("layer") + F.col("dist")).alias("layer"))
    return starts.union(above)


def _quoted(text: Column) -> Column:
    return F.coalesce(F.to_json(F.try_parse_json(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))), F.lit("null"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _paths(depth: int) -> Column:
    """Of `_given` (name -> value) all values as (path, parent, kind, json), objects and arrays opened to that depth."""

    def made(path, parent, value):
        return F.struct(path.alias("path"), parent.alias("parent"), value.alias("value"))

    def opened(e):
        text = F.to_json(e["value"])
        inside = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda x: made(F.concat(e["path"], F.lit("."), x["key"]), e["path"], x["value"]))
        items = F.transform(F.from_json(text, "array<variant>"), lambda x: made(F.concat(e["path"], F.lit("[]")), e["path"], x))
        return F.when(F.startswith(_kind(e["value"]), F.lit("OBJECT")), inside).otherwise(items)

    level = F.transform(F.map_entries("_given"), lambda x: made(x["key"], F.lit(""), x["value"]))
    every = level
    for _ in range(depth - 1):
        level = F.flatten(F.transform(F.filter(level, lambda e: F.rlike(_kind(e["value"]), F.lit("^(OBJECT|ARRAY)"))), opened))
        every = F.concat(every, level)
    return F.transform(every, lambda e: F.struct(e["path"].alias("path"), e["parent"].alias("parent"), _kind(e["value"]).alias("kind"), F.to_json(e["value"]).alias("json")))


def _errors() -> Column:
    """What is missing, of another type, not allowed or unknown in `_paths` against `fields`, sorted."""
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    own = lambda f: F.filter("_paths", lambda e: e["path"] == f["field"])
    parent = lambda f: F.regexp_replace(f["field"], r"(\.[^.\[]*|\[\])$", "")
    top = lambda f: ~F.rlike(f["field"], F.lit(r"\.|\[\]"))
    holders = lambda f: F.when(top(f), F.lit(1)).otherwise(F.size(F.filter("_paths", lambda e: (e["path"] == parent(f)) & F.startswith(e["kind"], F.lit("OBJECT")))))
    told = lambda what, found: F.transform(found, lambda f: F.concat(F.lit(what), f["field"]))
    missing = F.filter("fields", lambda f: f["required"] & (F.size(own(f)) < holders(f)))
    wrong = F.filter("fields", lambda f: F.exists(own(f), lambda e: ~F.coalesce(F.rlike(e["kind"], F.element_at(kind, f["type"])), F.lit(False))))
    barred = F.filter("fields", lambda f: f["allowed"].isNotNull() & F.exists(own(f), lambda e: ~F.array_contains(f["allowed"], e["json"])))
    known = lambda e: F.exists("fields", lambda f: (f["field"] == e["path"]) | F.startswith(f["field"], F.concat(e["path"], F.lit("."))) | F.startswith(f["field"], F.concat(e["path"], F.lit("[]"))))
    closed = lambda e: (e["parent"] == "") | F.exists("fields", lambda f: F.startswith(f["field"], F.concat(e["parent"], F.lit("."))))
    unknown = F.array_distinct(F.transform(F.filter("_paths", lambda e: ~F.endswith(e["path"], F.lit("[]")) & closed(e) & ~known(e)), lambda e: F.concat(F.lit("unknown "), e["path"])))
    every = F.array_sort(F.concat(told("missing ", missing), told("type of ", wrong), told("value of ", barred), unknown))
    return F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("_given").isNull(), F.array(F.lit("invalid arguments"))).otherwise(every)


def link(calls: DataFrame, results: DataFrame, tools: DataFrame, depth: int = 3) -> DataFrame:
    """calls: call_id, name, arguments (JSON), depends_on (array of call_id); results: call_id, content; tools: as schemas().

    Returns call_id, name, layer, status, errors, content, canonical.
    """
    calls = calls.select("call_id", "name", "arguments", "depends_on").where("call_id IS NOT NULL")
    calls = calls.groupBy("call_id").agg(F.min(F.struct("name", "arguments", "depends_on")).alias("c")).select("call_id", "c.*")
    results = results.select("call_id", "content").where("call_id IS NOT NULL").distinct()
    order = layers(calls, calls.select("call_id", F.explode("depends_on").alias("on")).where("on IS NOT NULL"))
    is_object = F.startswith(F.ltrim("arguments"), F.lit("{")) & F.try_parse_json("arguments").isNotNull()
    parsed = calls.withColumn("_given", F.when(is_object, F.from_json("arguments", "map<string,variant>")))
    parsed = parsed.withColumn("_paths", _paths(depth)).join(tools.select("name", "fields"), "name", "left").withColumn("errors", _errors())
    # A parsed value writes its keys in order, at every depth, and no blanks.
    parsed = parsed.withColumn("_json", F.coalesce(F.when(is_object, F.to_json(F.try_parse_json("arguments"))), F.lit("null")))
    calls = parsed.select("call_id", "name", "errors", "_json", F.lit(True).alias("_call")).join(order, "call_id", "left")
    both = calls.hint("shuffle_hash").join(results.withColumn("_result", F.lit(True)), "call_id", "full_outer")
    status = F.when(F.col("_call").isNull(), "no call").when(F.col("layer").isNull(), "cycle").when(F.col("_result").isNull(), "no result").otherwise("ok")
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce("_json", F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("content")), F.lit("}")
    )
    return both.select("call_id", "name", "layer", status.alias("status"), F.array_join("errors", "; ").alias("errors"), "content", canonical.alias("canonical"))


def derived(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls a tool named by its place, the assistant's turn after it is the result, and a call depends on the call two turns before."""
    turns = turns.select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    call = turns.where("role = 'user'").withColumn("text", F.coalesce("text", F.lit("")))
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"), F.length("text").alias("chars")))
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(F.col("turn"), F.lit(len(TOOLS))) + 1).cast("int"))
    calls = call.select(name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("depends_on"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived(table(spark, sf_dir, "conversations"))
    linked = link(calls, results, schemas(spark))
    return linked.select("call_id", "name", F.col("layer").cast("long").alias("layer"), "status", "errors", F.sha2("canonical", 256).alias("canonical_sha256"))


ORACLE_SQL = """
WITH RECURSIVE calls AS (
  SELECT DISTINCT conv_id, turn, conv_id || ':' || turn AS call_id, (['answer', 'lookup', 'outline'])[turn % 3 + 1] AS name,
         '{"chars":' || length(coalesce(text, '')) || ',"prompt":' || to_json(coalesce(text, ''))::VARCHAR || ',"turn":' || turn || '}' AS args
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT DISTINCT conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), layered AS (
  SELECT call_id, conv_id, turn, 0 AS layer FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.call_id, c.conv_id, c.turn, l.layer + 1 FROM layered l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2
)
SELECT coalesce(c.call_id, r.call_id) AS call_id, c.name, l.layer::BIGINT AS layer,
       CASE WHEN c.call_id IS NULL THEN 'no call' WHEN r.call_id IS NULL THEN 'no result' ELSE 'ok' END AS status,
       CASE c.name WHEN 'answer' THEN '' WHEN 'lookup' THEN 'type of turn' WHEN 'outline' THEN 'missing sections' END AS errors,
       sha256('{"arguments":' || coalesce(c.args, 'null') || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || coalesce('"' || c.name || '"', 'null')
              || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}') AS canonical_sha256
FROM calls c FULL JOIN results r ON c.call_id = r.call_id LEFT JOIN layered l ON l.call_id = c.call_id
"""
