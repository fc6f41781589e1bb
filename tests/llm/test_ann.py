import numpy as np

from pagemill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step, k=5):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(ok)
    x = np.stack([ok[i] for i in ids])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in ids:
        if i % step == 0:
            score = (x * ok[i]).sum(1) / (norm * np.sqrt((ok[i] * ok[i]).sum()))
            out[i] = [(j, s) for s, j in sorted((-s, j) for j, s in zip(ids, score, strict=True) if j != i)][:k]
    return out


def compare(spark, rows, step, least):
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(vectors, vectors.where(f"vec_id % {step} = 0")).collect()
    want = brute(rows, step)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert found.keys() == {q for q, near in want.items() if near}
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in want.items() if near)
    assert hits >= least * sum(map(len, want.values()))
    return found, want


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(100 + i, rows[0][1], 1) for i in range(20)]  # equal vectors: ties to the smaller id
    rows += [(200, None, 0), (205, [0.0] * 8, 0), (210, [1.0] * 7 + [float("nan")], 0), (215, [1.0] * 7 + [None], 0), (220, [1.0] * 7 + [float("inf")], 0)]
    found, want = compare(spark, rows, 5, 1.0)
    for q, near in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in found[q]], [-s for _, s in near], atol=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 4 == 0)).astype(np.float32).tolist(), 0) for i in range(4000)]
    compare(spark, rows, 50, 0.9)


def test_few_and_none(spark):
    compare(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], 1, 1.0)
    assert ann.search(*[spark.createDataFrame([], SCHEMA)] * 2).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert ann.search(one, one).count() == 0


def test_leaves_that_grow_have_trees_of_their_own(spark, monkeypatch):
    for name, value in (("SAMPLE", 300), ("FINE", 60), ("FINE_SAMPLE", 200), ("LEAF", 20), ("BLOCK_VECTORS", 500), ("BLOCK_QUERIES", 40)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 4 * np.eye(8)[i % 8 * (i % 3 > 0)]).astype(np.float32).tolist(), 0) for i in range(3000)]
    compare(spark, rows, 20, 0.9)


def test_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (0, [1.0, 0.0], 0), (2, [0.0, 1.0, 0.0], 0), (3, [0.0, 1.0, 0.5], 0), (4, [1.0], 0), (5, [1.0, 0.2], 0), (5, [0.5, 0.5], 0)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(ann.search(vectors, vectors.where("vec_id < 5")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 5, 5], 1: [5, 0, 5], 2: [3], 3: [2]}


def test_visits_come_in_batches_of_bounded_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ann, "VISITED", 1 << 10, raising=False)
    x = np.random.default_rng(5).normal(size=(400, 8))
    tree = ann.Tree(ann._unit(x), 20.0)
    visits = min(30, tree.leaves())
    batch = pa.RecordBatch.from_pydict({"vector": x.tolist(), "gid": list(range(400))})
    out = list(ann._visit(tree, visits)(iter([batch, batch.slice(0, 0)])))
    assert all(b.num_rows * 8 <= 1 << 10 for b in out)
    want = [(i, leaf) for i, q in enumerate(ann._unit(x)) for _, leaf in zip(range(visits), tree.visit(q))]
    assert [(g, leaf) for b in out for g, leaf in zip(b["gid"].to_pylist(), b["leaf"].to_pylist())] == want
    assert all(b["vector"].to_pylist() == [x[g].tolist() for g in b["gid"].to_pylist()] for b in out)


def test_a_query_travels_once_to_a_bin(spark, monkeypatch):
    """Not once to each leaf: most queries visit most leaves, and vectors took queries times leaves of disk."""
    monkeypatch.setattr(ann, "LEAF", 20)
    staged, stage = {}, ann.stage
    monkeypatch.setattr(ann, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(3000)]
    compare(spark, rows, 50, 0.9)
    assert staged["visits"].count() == 60


def test_blocks_give_the_nearest_of_the_leaves_that_visits_reach(monkeypatch):
    import pyarrow as pa

    for name, value in (("TILE_QUERIES", 7), ("TILE_VECTORS", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:340] = x[0] * rng.integers(1, 4, (40, 1)).astype(np.float32)
    tree, visits = ann.Tree(ann._unit(x), 3.0), 4
    reached = tree.reached(ann._unit(x), visits)
    for q, own in zip(ann._unit(x), reached, strict=True):
        assert own[[leaf for _, leaf in zip(range(visits), tree.visit(q))]].all()
    leaf, bins = tree.assign(ann._unit(x)), [np.flatnonzero(reached.any(0))]
    queries = list(ann._reach(tree, visits, bins)(iter([pa.RecordBatch.from_pydict({"vector": list(x[:50]), "gid": list(range(50))})])))
    at = {"leaf": -1, "bin": 0, "v": 0, "q": 0}
    schema = pa.schema([*((k, pa.int64()) for k in at), ("kind", pa.int32()), ("cell", pa.int64()), ("cells", pa.binary()), ("gid", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float32()))])
    members = [at | {"kind": 0, "cell": int(np.searchsorted(bins[0], leaf[i])), "gid": i, "ids": [i], "vector": x[i]} for i in range(900) if leaf[i] in bins[0]]
    asked = [at | {"kind": 1, "cells": r["cells"], "gid": r["gid"], "vector": r["vector"]} for b in queries for r in b.to_pylist()]
    got = {}
    for b in ann._meet(iter([pa.RecordBatch.from_pylist(part, schema) for part in (members[:500], members[500:] + asked[:20], asked[20:])])):
        for r in b.to_pylist():
            got.setdefault(r["query"], []).append((-r["score"], r["vec_id"]))
    d = x.astype(float)
    for q in range(50):
        score = (d * d[q]).sum(1) / (np.sqrt((d * d).sum(1)) * np.sqrt((d[q] * d[q]).sum()))
        assert sorted(got[q]) == sorted((-score[i], i) for i in range(900) if reached[q, leaf[i]])[: ann.K + 1]
