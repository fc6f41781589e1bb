"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The upper tree is fitted on a bounded sample (SAMPLE vectors); every vector is then put into its leaf. A query
goes down the tree through a priority queue of branches, nearest centre first, and visits leaf after leaf.
How many leaves is calibrated on sampled queries against brute force over the sample: visits
widen until their recall reaches RECALL. A leaf that holds more than FINE vectors gets a tree of its own, fitted on
a sample of FINE_SAMPLE of its vectors and calibrated on these, so that cells stay small as the table grows;
queries that visit the leaf search that tree in the same way.

Leaves that lie side by side make a bin of up to BIN numbers; a leaf with a tree of its own has bins of its cells. A query goes to a bin once, with its
vector and a bit for each leaf it visits there, and streams past the bin's vectors, which one task holds. Products in single
precision find what may be among the nearest, with room for their error; scores are in double precision.

Equal vectors are indexed once, with their K + 1 smallest ids; as ties go to the smaller id, no other can be
among the K nearest of any query. Bins of more queries than ASKED, and single cells of more vectors than a bin, are split into blocks.
Vectors that are null or zero, or hold null or non-finite components, take no part. Vectors of each length have a tree of their own,
and are candidates of queries of that length only. A query with no candidate has no row. Rows that repeat a vec_id and its vector
count as one; further vectors of a vec_id are candidates under the same id, and queries of their own. Other columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stage, table

K = 5
SAMPLE, CALIBRATION = 20_000, 256
BRANCH, LEAF = 8, 150
RECALL = 0.98
#: Vectors beyond which a leaf has a tree of its own, the sample that tree is fitted on, and its recall.
FINE, FINE_SAMPLE, FINE_RECALL = 4096, 2048, 0.995
#: Vectors and queries of a leaf that go through its own tree in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Numbers in the vectors of one batch of visits to leaves with trees of their own.
VISITED = 1 << 20
#: Numbers in the vectors of a bin, queries that stream past one copy of it, and queries and vectors in one product.
BIN, ASKED = 1 << 22, 1 << 16
TILE_QUERIES, TILE_VECTORS = 1024, 2048


class Tree:
    """Centres of unit vectors; node 0 is the root, a node without children a leaf."""

    def __init__(self, sample: np.ndarray, scale: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self._grow(sample, scale, rng, 0)

    def _grow(self, x: np.ndarray, scale: float, rng, depth: int) -> int:
        me = len(self.children)
        self.children.append(np.zeros(0, np.int64))
        self.centres.append(np.zeros((0, x.shape[1])))
        if len(x) * scale <= LEAF or len(x) < 2 * BRANCH or depth > 12:
            return me
        centres = x[rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(8):
            at = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
        at = np.argmax(x @ centres.T, axis=1)
        used = np.unique(at)
        if len(used) < 2:
            return me
        self.children[me] = np.array([self._grow(x[at == c], scale, rng, depth + 1) for c in used])
        self.centres[me] = centres[used]
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(self.children[node]):
                out[rows] = node
                continue
            best = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            todo += [(int(child), rows[best == c]) for c, child in enumerate(self.children[node]) if (best == c).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not len(self.children[node]):
                yield node
                continue
            for far, child in zip(-(self.centres[node] @ q), self.children[node], strict=True):
                heapq.heappush(queue, (float(far), int(child)))

    def reached(self, q: np.ndarray, visits: int) -> np.ndarray:
        """Of each query and node whether it is one of the first leaves that visit() gives, or a leaf that comes with the last of them."""
        # A leaf comes when the farthest branch on its way has come; parents have smaller numbers than their children.
        far = np.full((len(q), len(self.children)), -np.inf)
        for node, (children, centres) in enumerate(zip(self.children, self.centres, strict=True)):
            if len(children):
                far[:, children] = np.maximum(-(q @ centres.T), far[:, [node]])
        leaf = np.array([not len(c) for c in self.children])
        last = min(visits, int(leaf.sum())) - 1
        return leaf & (far <= np.partition(far[:, leaf], last, axis=1)[:, [last]])

    def leaves(self) -> int:
        return sum(not len(c) for c in self.children)


def calibrate(tree: Tree, sample: np.ndarray, target: float = RECALL) -> int:
    """The smallest number of leaf visits with which sampled queries find the target share of their nearest."""
    queries = np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int)
    leaf, needed = tree.assign(sample), []
    for q in queries:
        near = sample @ sample[q]
        near[q] = -2
        k = min(K, len(sample) - 1)
        rank = {node: i for i, node in enumerate(tree.visit(sample[q]))}
        needed += [rank[int(leaf[i])] + 1 for i in np.argpartition(-near, k - 1)[:k]] if k > 0 else []
    visits = 1
    while needed and np.mean(np.array(needed) <= visits) < target:
        visits += 1
    return visits


def _matrix(column) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    if not len(column):
        return np.zeros((0, 1))
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(_unit(_matrix(b.column("vector")))))], names=[*b.schema.names, "leaf"])

    return run


def _visit(tree: Tree, visits: int, own: list[int] | None = None):
    """A row for each leaf a query visits, in their order, or for those with trees of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units = _unit(_matrix(b.column("vector")))
            # A query is a row for each leaf it visits, with its vector: all of a batch would not fit.
            step = max(1, min(256, VISITED // (min(visits, len(own or tree.children)) * units.shape[1])))
            for low in range(0, len(units), step):
                part, asking = b.slice(low, step), units[low : low + step]
                if own is None:
                    rows, leaves = np.array([(i, leaf) for i, q in enumerate(asking) for leaf in islice(tree.visit(q), visits)]).T
                else:
                    rows, at = np.nonzero(tree.reached(asking, visits)[:, own])
                    leaves = np.array(own)[at]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows, pa.int64())).columns, pa.array(leaves, pa.int64())], names=[*b.schema.names, "leaf"])

    return run


def _bits(at: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.packbits(at, axis=1, bitorder="little")]


def _reach(tree: Tree, visits: int, bins: list[np.ndarray]):
    """A row for each bin that a query visits leaves of, with bits that tell which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                reached = tree.reached(_unit(_matrix(part.column("vector"))), visits)
                for number, leaves in enumerate(bins):
                    own = reached[:, leaves]
                    rows = np.flatnonzero(own.any(1))
                    if len(rows):
                        some = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([some.column("vector"), some.column("gid"), pa.array(np.full(len(rows), number)), pa.array(_bits(own[rows]), pa.binary())], names=["vector", "gid", "bin", "cells"])

    return run


class Block:
    """Vectors of a bin by cell. What it gives for a query are its K + 1 nearest in the cells it visits, ties to the smaller id."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows.column("cell").to_numpy(), kind="stable")))
        self.cells, self.starts = np.unique(rows.column("cell").to_numpy(), return_index=True)
        self.vectors, self.gid = _matrix(rows.column("vector")), rows.column("gid").to_numpy()
        ids = rows.column("ids").combine_chunks()
        self.ids, self.sizes = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.norm, self.unit = self._split(self.vectors)
        #: What a product in single precision may be off by.
        self.error = np.float32((self.vectors.shape[1] + 8) * 2.0**-23)

    @staticmethod
    def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        with np.errstate(all="ignore"):
            return norm, np.nan_to_num(x / norm[:, None]).astype(np.float32)

    def _scores(self, rows: np.ndarray, q: np.ndarray, nq: np.ndarray, asking: np.ndarray) -> np.ndarray:
        """In double precision on the original vectors. Sums along rows, not a matrix product: equal vectors get equal scores wherever they stand."""
        out, step = np.empty(len(rows)), max(1, (1 << 21) // q.shape[1])
        for low in range(0, len(rows), step):
            x, y = rows[low : low + step], asking[low : low + step]
            with np.errstate(all="ignore"):
                out[low : low + step] = (self.vectors[x].astype(np.float64) * q[y]).sum(1) / (self.norm[x] * nq[y])
        return np.where(np.isnan(out), -np.inf, out)

    def nearest(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(queries.column("vector")).astype(np.float64)
        nq, unit = self._split(q)
        bits = np.unpackbits(np.frombuffer(b"".join(queries.column("cells").to_pylist()), np.uint8).reshape(len(q), -1), axis=1, bitorder="little")
        score, row = np.full((len(q), K + 1), -np.inf), np.full((len(q), K + 1), -1)
        for cell, start, end in zip(self.cells, self.starts, [*self.starts[1:], len(self.gid)], strict=True):
            asking = np.flatnonzero(bits[:, cell])
            for low in range(start, end if len(asking) else start, TILE_VECTORS):
                rough = unit[asking] @ self.unit[low : min(end, low + TILE_VECTORS)].T
                least = score[asking, K].astype(np.float32) - self.error
                new = np.flatnonzero(np.isneginf(least))
                if len(new) and rough.shape[1] > K + 1:
                    least[new] = np.partition(rough[new], -K - 1, axis=1)[:, -K - 1] - 2 * self.error
                some = np.flatnonzero(rough.max(1) >= least)
                if not len(some):
                    continue
                i, j = np.divmod(np.flatnonzero((rough[some] >= least[some, None]).ravel()), rough.shape[1])
                i = some[i]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                who, size = asking[i[first]], np.diff(np.r_[first, len(i)])
                # What these queries have so far, and beside it what is new.
                both, rows = np.full((len(who), K + 1 + size.max()), -np.inf), np.full((len(who), K + 1 + size.max()), -1)
                both[:, : K + 1], rows[:, : K + 1] = score[who], row[who]
                at = np.repeat(np.arange(len(who)), size), K + 1 + np.arange(len(i)) - np.repeat(first, size)
                both[at], rows[at] = self._scores(low + j, q, nq, asking[i]), low + j
                best = np.lexsort((self.gid[rows], -both), axis=1)[:, : K + 1]
                score[who], row[who] = np.take_along_axis(both, best, 1), np.take_along_axis(rows, best, 1)
        held = (row >= 0) & (score > -np.inf)
        asked, score, row = np.repeat(queries.column("gid").to_numpy(), held.sum(1)), score[held], row[held]
        n = self.sizes[row]
        ids = self.ids[np.repeat(self.first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(ids), pa.array(np.repeat(score, n))], names=["query", "vec_id", "score"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, vectors before queries: a block's vectors are held, its queries stream past."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "bin", "v", "q", "kind")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
        for s, e in pairwise(cuts):
            if key != (key := tuple(keys[:4, s])):
                held, block = [], None
            part = batch.slice(s, e - s)
            if keys[4, s] == 0:
                held.append(part)
            elif held:
                block = block or Block(pa.Table.from_batches(held))
                for low in range(0, part.num_rows, TILE_QUERIES):
                    yield block.nearest(part.slice(low, TILE_QUERIES))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """A leaf's own tree and its number of visits."""
    x = _unit(np.stack(rows["vector"].to_numpy()).astype(np.float64))
    tree = Tree(x, float(rows["n"].iloc[0]) / len(x))
    return pd.DataFrame({"leaf": [rows["leaf"].iloc[0]], "tree": [pickle.dumps((tree, calibrate(tree, x, FINE_RECALL)))]})


def _into_cells(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    if len(rows):
        rows["cell"] = pickle.loads(trees["tree"].iloc[0])[0].assign(_unit(np.stack(rows["vector"].to_numpy())))
    return rows[["vector", "ids", "gid", "leaf", "cell"]] if len(rows) else pd.DataFrame({"vector": [], "ids": [], "gid": [], "leaf": [], "cell": []})


def _to_bins(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """A row for each bin of its leaf that a query visits cells of, with bits that tell which."""
    out = {"vector": [], "gid": [], "leaf": [], "bin": [], "cells": []}
    if len(rows):
        tree, visits = pickle.loads(trees["tree"].iloc[0])
        places = pd.DataFrame([(p["node"], p["bin"], p["cell"]) for p in trees["places"].iloc[0]], columns=["node", "bin", "cell"]).sort_values(["bin", "cell"])
        reached = tree.reached(_unit(np.stack(rows["vector"].to_numpy())), visits)
        for number, own in places.groupby("bin"):
            visited = reached[:, own["node"].to_numpy()]
            some = np.flatnonzero(visited.any(1))
            for k, v in zip(out, (rows["vector"].iloc[some], rows["gid"].iloc[some], rows["leaf"].iloc[some], [number] * len(some), _bits(visited[some])), strict=True):
                out[k] += list(v)
    return pd.DataFrame(out)


def _own(members: DataFrame, large: DataFrame, asked: DataFrame, rows: int, vector: str) -> DataFrame:
    """The rows that _meet takes for leaves with trees of their own: these leaves' members, and the queries with the leaves they visit of these."""
    large = stage(large, "large")
    members = members.hint("merge").join(large, "leaf")
    some = Window.partitionBy("leaf").orderBy(F.xxhash64("gid"), "gid")
    sample = members.withColumn("r", F.row_number().over(some)).where(F.col("r") <= FINE_SAMPLE)
    trees = stage(sample.select("leaf", "n", "vector").groupBy("leaf").applyInPandas(_fit, "leaf long, tree binary"), "trees")

    def through(of: DataFrame, trees: DataFrame, rule, columns: str, size: int) -> DataFrame:
        """Rows through the rule with the tree of their leaf, in blocks."""
        counts = of.groupBy("leaf").agg(F.expr(f"cast(ceil(count(*) / {size}) as int)").alias("nb"))
        held = of.hint("merge").join(counts, "leaf").withColumn("block", F.expr("pmod(xxhash64(gid), nb)"))
        dealt = trees.join(counts, "leaf").select(*trees.columns, F.explode(F.expr("sequence(0L, cast(nb as long) - 1)")).alias("block"))
        return held.groupBy("leaf", "block").cogroup(dealt.groupBy("leaf", "block")).applyInPandas(rule, columns)

    placed = stage(through(members.drop("n"), trees, _into_cells, f"vector {vector}, ids array<long>, gid long, leaf long, cell long", BLOCK_VECTORS), "cells")
    bins = placed.groupBy("leaf", F.col("cell").alias("node")).count().withColumn("bin", F.expr(f"cast((sum(count) OVER (PARTITION BY leaf ORDER BY node) - count) div {rows} as long)"))
    places = stage(bins.select("leaf", "node", "bin", (F.row_number().over(Window.partitionBy("leaf", "bin").orderBy("node")) - 1).cast("long").alias("cell")), "places")
    listed = trees.join(places.groupBy("leaf").agg(F.collect_list(F.struct("node", "bin", "cell")).alias("places")), "leaf")
    wanted = stage(through(asked, listed, _to_bins, f"vector {vector}, gid long, leaf long, bin long, cells binary", BLOCK_QUERIES), "visits")
    placed = placed.withColumnRenamed("cell", "node").hint("merge").join(places, ["leaf", "node"])
    at = ["leaf", "bin"]
    blocks = placed.groupBy(*at).agg(F.expr(f"cast(ceil(count(*) / {2 * rows}) as long)").alias("nv")).join(wanted.groupBy(*at).agg(F.expr(f"cast(ceil(count(*) / {ASKED}) as long)").alias("nq")), at)
    spread = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = placed.hint("merge").join(blocks, at).select(*at, F.expr("pmod(xxhash64(gid), nv)").alias("v"), spread("nq").alias("q"), F.lit(0).alias("kind"), "cell", F.lit(None).cast("binary").alias("cells"), "gid", "ids", "vector")
    right = wanted.hint("merge").join(blocks, at).select(*at, spread("nv").alias("v"), F.expr("pmod(xxhash64(gid), nq)").alias("q"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cell"), "cells", "gid", F.lit(None).cast("array<long>").alias("ids"), "vector")
    return left.union(right)


def _of_length(groups: DataFrame, known: DataFrame, length: int, size: int) -> DataFrame:
    """query (the smallest id of equal vectors) and its list near of n, vec_id, score, for vectors and queries of one length, of which there are `size` different ones."""
    spark, vector = groups.sparkSession, groups.schema["vector"].dataType.simpleString()
    sample = _unit(_matrix(groups.orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("vector").toArrow().column(0)))
    tree = Tree(sample, size / len(sample))
    visits = calibrate(tree, sample)
    members = stage(groups.mapInArrow(_assign(tree), f"vector {vector}, ids array<long>, gid long, leaf long"), "leaves")
    # Queries are asked once for each different vector.
    distinct = known.groupBy("vector").agg(F.min("query_id").alias("gid"))
    counts = members.groupBy("leaf").agg(F.count("*").alias("n"))
    # Leaves are as many as the sample allows, so the driver may hold their counts.
    held, rows, bins = dict(counts.orderBy("leaf").collect()), max(1, BIN // length), [[]]
    for leaf, n in held.items():
        if n <= FINE:
            if bins[-1] and sum(held[x] for x in bins[-1]) + n > rows:
                bins.append([])
            bins[-1].append(leaf)
    parts = []
    if bins[0]:
        wanted = stage(distinct.mapInArrow(_reach(tree, visits, [np.array(b) for b in bins]), f"vector {vector}, gid long, bin long, cells binary"), "visits")
        copies = {b: -(-n // ASKED) for b, n in wanted.groupBy("bin").count().collect()}
        places = spark.createDataFrame([(leaf, b, cell, copies[b]) for b, own in enumerate(bins) for cell, leaf in enumerate(own) if b in copies], "leaf long, bin long, cell long, nq long")
        nq = spark.createDataFrame(list(copies.items()), "bin long, nq long")
        none = F.lit(-1).cast("long").alias("leaf")
        left = members.join(F.broadcast(places), "leaf").select(none, "bin", F.lit(0).cast("long").alias("v"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("q"), F.lit(0).alias("kind"), "cell", F.lit(None).cast("binary").alias("cells"), "gid", "ids", "vector")
        right = wanted.join(F.broadcast(nq), "bin").select(none, "bin", F.lit(0).cast("long").alias("v"), F.expr("pmod(xxhash64(gid), nq)").alias("q"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cell"), "cells", "gid", F.lit(None).cast("array<long>").alias("ids"), "vector")
        parts += [left, right]
    if own := [leaf for leaf, n in held.items() if n > FINE]:
        asked = stage(distinct.mapInArrow(_visit(tree, visits, own), f"vector {vector}, gid long, leaf long"), "asked")
        parts.append(_own(members, counts.where(F.col("n") > FINE), asked, rows, vector))
    at = ["leaf", "bin", "v", "q"]
    met = reduce(DataFrame.union, parts).repartition(*at).sortWithinPartitions(*at, "kind")
    found = met.mapInArrow(_meet, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= K + 1)
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    return known.join(lists.join(distinct.withColumnRenamed("gid", "query"), "query"), "vector").select("query_id", "near")


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The K nearest of each query among vectors, its own id left out: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    # Numbers of single precision stay so while they are dealt out.
    kind = "array<float>" if all(df.schema[column].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "array<double>"
    usable = lambda df: (
        df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast(kind).alias("vector"))
        .where("id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)")
        .distinct()
    )
    everything, asked = usable(vectors), usable(queries).withColumnRenamed("id", "query_id")
    own = Window.partitionBy("vector").orderBy("id")
    groups = everything.withColumn("n", F.row_number().over(own)).where(F.col("n") <= K + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = stage(groups.withColumn("gid", F.element_at("ids", 1)), "vectors")
    # A table has one length of vectors as a rule; each length that queries have is searched by itself.
    sizes = groups.groupBy(F.size("vector").alias("d")).count().join(asked.select(F.size("vector").alias("d")).distinct(), "d").orderBy("d").collect()
    parts = [_of_length(groups.where(F.size("vector") == d), asked.where(F.size("vector") == d), d, n) for d, n in sizes]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = reduce(DataFrame.union, parts).select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {K})").alias("near"))
    return lists.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
