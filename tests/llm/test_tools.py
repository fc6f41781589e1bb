import json

from pagemill.llm import tools

CALLS = "call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "call_id string, content string"


def run(spark, calls, results, schema=None):
    got = tools.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools.schemas(spark, schema or {"f": [("a", "integer", True), ("b", "string", False), ("c", "array", False)]}))
    return {(r.call_id, r.content): r for r in got.collect()}


def test_link_order_and_status(spark):
    calls = [("1", "f", '{"a":1}', None), ("2", "f", '{"a":2}', ["1", "gone"]), ("3", "f", '{"a":3}', ["1", "2", None]), ("4", "f", '{"a":1}', ["5"]), ("5", "f", '{"a":1}', ["4"]), ("6", "f", '{"a":1}', ["5"]), ("2", "f", '{"a":2}', ["1", "gone"]), (None, "f", "{}", [])]
    got = run(spark, calls, [("1", "x"), ("1", "x"), ("3", None), ("9", "lost"), ("2", "p"), ("2", "q"), (None, "z")])
    assert {k: (r.layer, r.status) for k, r in got.items()} == {
        ("1", "x"): (0, "ok"), ("2", "p"): (1, "ok"), ("2", "q"): (1, "ok"), ("3", None): (2, "ok"), ("4", None): (None, "cycle"), ("5", None): (None, "cycle"), ("6", None): (None, "cycle"), ("9", "lost"): (None, "no call"),
    }


def test_arguments_and_canonical_json(spark):
    args = {"1": '{"b": "\\u00e9\\n", "a": 1, "c": [ {"z":1,"y":null} ]}', "2": '{"a":"1","d":2}', "3": "not json", "4": None, "5": "[1]", "6": '{"a":1}', "7": "{}"}
    got = run(spark, [(k, "g" if k == "6" else "f", v, []) for k, v in args.items()], [("1", 'say "hi"\t\\')])
    found = {k[0]: r.errors for k, r in got.items()}
    assert found == {"1": "", "2": "type of a; unknown d", "3": "invalid arguments", "4": "invalid arguments", "5": "invalid arguments", "6": "unknown tool", "7": "missing a"}
    text = next(r.canonical for k, r in got.items() if k[0] == "1")
    want = {"arguments": json.loads(args["1"]), "id": "1", "name": "f", "result": 'say "hi"\t\\'}
    assert text == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_nested_fields_are_checked(spark):
    schema = {"f": [("o", "object", True), ("o.lang", "string", True, ['"en"', '"de"']), ("o.deep.n", "integer", False), ("tags", "array", False), ("tags[]", "string", False), ("rows[].id", "integer", True), ("rows", "array", False), ("free", "object", False)]}
    args = {
        "1": ('{"o":{"lang":"en","deep":{"n":1}},"tags":["a"],"rows":[{"id":1}],"free":{"x":1}}', ""),
        "2": ('{"o":{"lang":"fr","deep":{"n":"x"}},"tags":["a",2]}', "type of o.deep.n; type of tags[]; value of o.lang"),
        "3": ('{"o":{"other":1},"rows":[{"id":1},{}]}', "missing o.lang; missing rows[].id; unknown o.other"),
        "4": ('{"o":3}', "type of o"),
    }
    got = run(spark, [(k, "f", v[0], []) for k, v in args.items()] + [("5", None, "{}", None)], [], schema)
    assert {k[0]: r.errors for k, r in got.items()} == {k: v[1] for k, v in args.items()} | {"5": "unknown tool"}


def brute_layers(deps):
    known = {}
    while new := {k: 1 + max((known[d] for d in v), default=-1) for k, v in deps.items() if k not in known and all(d in known for d in v)}:
        known |= new
    return known


def test_layers_of_chains_and_graphs(spark):
    import random

    rng = random.Random(3)
    deps = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(5000)}  # one chain
    deps |= {f"s{i}": ["c0"] for i in range(300)}  # many on one call
    for i in range(300):  # graphs, some with cycles
        pool = [f"g{j}" for j in range(300 if i % 50 == 0 else i) if j // 10 == i // 10]
        deps[f"g{i}"] = rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 2, 3])))
    nodes = spark.createDataFrame([(k,) for k in deps], "call_id string")
    edges = spark.createDataFrame([(k, d) for k, v in deps.items() for d in v], "call_id string, on string")
    got = {r.call_id: r.layer for r in tools.layers(nodes, edges).collect()}
    assert got == brute_layers(deps) and got["c4999"] == 4999 and len(got) < len(deps)


def test_long_texts_ties_and_other_columns(spark):
    long = '{"a":1,"b":"' + "x" * 200_000 + '"}'
    calls = spark.createDataFrame([("1", "f", long, None, "q"), ("2", "f", '{"a":2}', ["1"], "q"), ("2", "f", '{"a":1}', None, "q")], CALLS + ", errors string")
    results = spark.createDataFrame([("1", "y" * 200_000, 1)], RESULTS + ", layer int")
    got = {r.call_id: r for r in tools.link(calls, results, tools.schemas(spark, {"f": [("a", "integer", True), ("b", "string", False)]})).collect()}
    assert len(got["1"].canonical) > 400_000 and got["1"].errors == "" and (got["2"].layer, got["2"].canonical[:22]) == (0, '{"arguments":{"a":1},"')
