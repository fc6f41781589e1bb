"""N-gram Jaccard join: shingle sets as points of group counts, found through an R-tree.

A document's words (A-Z in lower case) give its set of shingles, held as 64-bit hashes. Equal sets are one
class, with the smallest doc_id as representative; what follows sees only representatives.

Dealing out. Sets A and B that link differ in at most r = (|A|+|B|)(100-p)/(100+p) shingles. Hash the
shingles of a size band into more than r groups: one group at least is the same in A and B. So each set sends
its id, keyed by the hash of each group's content, to a bucket, and no linked pair misses all
buckets. Empty groups may be skipped as long as a set has no more of them than there are groups to spare.

Stars. In each bucket the smallest set is its head. Each set is first held against one head: that of most of its buckets.
A group of copies so takes a pair for each of its members. Links found make components, and buckets
all of whose sets are in one are closed: they have nothing more to find.

Bounds. Each set is a point: its counts of shingles in DIMENSIONS other hash groups. The overlap of two sets is at most the sum of the
smaller counts. A second exact bound is the parities of the numbers of shingles in each of up to PARITY groups: two sets differ
in at least as many shingles as parities. Pairs of which a bound shows that they do not link need no verifying.

Index. Open buckets of up to LEAF sets, which are one leaf, give their pairs of different components, each once whatever the number of
its buckets. In larger ones the points are held by an R-tree: the overlap of a set and a box is at most the sum of minima with the box's
upper corner, and boxes and points below the needed overlap are passed over. Buckets of more than BLOCK sets are
indexed in blocks, and their sets ask all blocks.

Verifying. What the bounds leave is verified exactly on the texts' sets. In large buckets each set first gives its
RANKS best partners; where that was not all, buckets that are still open give all that were not asked yet. No link between documents is lost.

Hot buckets. Members of a bucket stream through a task sorted, and are never held together. Signatures that a sample of rows
shows to be in more than HOT sets are dealt out by sets instead; the sample only chooses the way, both give the same members.

A text that is null or has no words has no set and no links. Rows that repeat a doc_id are rows of one document:
its versions (by text) have sets, buckets and links of their own, and are linked with one another; rows without a doc_id link with nothing.
Staged tables are deleted as soon as what follows is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop, ship, stage, table, trim

DIMENSIONS, LEAF, FAN = 64, 32, 16
BLOCK = 4096
#: Parity bits of a set at most.
PARITY = 8192
#: Partners in a large bucket that each set gives at first.
RANKS = 4
#: Sets of a signature beyond which it is dealt out by sets, and the share of rows by which that is told.
HOT, SHARE = 1_000_000, 0.01
MEMORY = 200_000
CHUNK = 2 << 20
#: Bytes of parities that are compared at once; a sixteenth as many pairs come from the tree.
TILE = 1 << 22

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    counts, hashes = [], []
    for t in texts:
        own = (t or "").encode().lower().split()
        counts.append(len(own))
        hashes += [_words[w] for w in own]
    h = mix(np.array(hashes, np.uint64) + _M3)
    out, at = [], 0
    windows = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        windows = mix(windows * _M3 + h[i : len(h) - n + 1 + i])
    for c in counts:
        if c >= n:
            out.append(np.unique(windows[at : at + c - n + 1]))
        elif c:
            whole = h[at : at + 1].copy()
            for i in range(1, c):
                whole = mix(whole * _M3 + h[at + i : at + i + 1])
            out.append(whole ^ np.uint64(c * 0x1000193))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def band_starts(limit: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return out


_BANDS = band_starts()


def groups_of(band: int, percent: int) -> tuple[int, int]:
    """Hash groups of a band, and how many of them a set may have empty without sending these too."""
    largest = _BANDS[band + 1] - 1
    least = 2 * largest * (100 - percent) // (100 + percent) + 1
    spare = 0 if least == 1 else 1 + least // 16
    return least + spare, spare


def signatures(x: np.ndarray, percent: int) -> np.ndarray:
    n = len(x)
    band = int(np.searchsorted(_BANDS, n, "right")) - 1
    bands, mixed, out = [band], mix(x ^ _M1), []
    while 100 * n >= percent * _BANDS[bands[-1] + 1]:
        bands.append(bands[-1] + 1)
    for b in bands:
        m, spare = groups_of(b, percent)
        group = ((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, group, mix(x + _M2))
        full = np.zeros(m, bool)
        full[group] = True
        keys = mix(sums + mix(np.arange(m, dtype=np.uint64) * _M3 + np.uint64(b * 7919 + 1)))
        out.append(keys if m - full.sum() > spare else keys[full])
    return np.concatenate(out)


def parity(x: np.ndarray) -> bytes:
    """Bits, as many as a power of two near the set's size, that tell whether a group has an odd number of shingles."""
    bits = min(PARITY, max(64, 1 << (len(x) - 1).bit_length()))
    return np.packbits(np.bincount((mix(x + _M3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def point(x: np.ndarray) -> bytes:
    """Counts of shingles in DIMENSIONS groups, in one byte each if that holds them."""
    counts = np.bincount((mix(x + _M1) >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def points_of(rows: list[bytes]) -> np.ndarray:
    size = np.array([len(r) for r in rows])
    out = np.empty((len(rows), DIMENSIONS), np.int32)
    for k, kind in ((DIMENSIONS, "u1"), (4 * DIMENSIONS, "<u4")):
        own = np.flatnonzero(size == k)
        if len(own):
            out[own] = np.frombuffer(b"".join([rows[i] for i in own]), kind).reshape(-1, DIMENSIONS)
    return out


def folded(marks: list[bytes], to: int) -> np.ndarray:
    """Parities as rows of `to` bytes: halves are folded together as often as that asks."""
    size = np.array([len(m) for m in marks])
    out = np.empty((len(marks), to), np.uint8)
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        out[own] = np.bitwise_xor.reduce(np.frombuffer(b"".join([marks[i] for i in own]), np.uint8).reshape(len(own), -1, to), axis=1)
    return out.view(np.uint64)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t or "")
        if size > CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def _sets(n: int, percent: int):
    """Of each text the size and key of its set, counts, parities and, where its task has not met the set lately, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        met: set[bytes] = set()
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in _chunks(batch.column(1).to_pylist()):
                size, key, counts, marks, sigs, ends = [], [], [], [], [], [0]
                # A row without a doc_id links with nothing: another one's signatures must not be left to it.
                for known, x in zip(ids.slice(at, len(texts)).is_valid().to_pylist(), shingles(texts, n), strict=True):
                    size.append(len(x))
                    if len(x):
                        key.append(xxhash.xxh3_128_digest(x.tobytes()))
                        counts.append(point(x))
                        marks.append(parity(x))
                        if not known or key[-1] in met:
                            ends.append(ends[-1])
                            continue
                        if len(met) > MEMORY:
                            met.clear()
                        met.add(key[-1])
                        sigs.append(signatures(x, percent).astype(np.int64))
                        ends.append(ends[-1] + len(sigs[-1]))
                    else:
                        key.append(None)
                        counts.append(None)
                        marks.append(None)
                        ends.append(ends[-1])
                flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(counts, pa.binary()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", "version", "n_shingles", "set_key", "counts", "parity", "signatures"],
                )
                at += len(texts)
        trim()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (signature, node), sorted, the members of signatures that two nodes or more have; of signatures that have the same members in one batch, one."""
    sig = node = np.zeros(0, np.int64)
    open_ = last = None  # signature of which rows have gone out already, and the last node of it

    def rows(bucket, members):
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(members)], names=["bucket", "node"])

    def whole(sig, node):
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[first, len(sig)])
        keys = mix(np.add.reduceat(mix(node.view(np.uint64) + _M2), first) + size.astype(np.uint64)).astype(np.int64)
        several = np.flatnonzero(size > 1)
        several = several[np.unique(keys[several], return_index=True)[1]]
        n = size[several]
        at = np.repeat(first[several], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return rows(np.repeat(keys[several], n), node[at])

    for batch in batches:
        new = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(new[0]):
            continue
        if open_ is not None:
            own = int(np.searchsorted(new[0], open_, "right"))
            more = np.unique(new[1][:own])
            more = more[more != last]
            if len(more):
                yield rows(np.full(len(more), open_), more)
                last = more[-1]
            new = new[0][own:], new[1][own:]
            if not len(new[0]):
                continue
            open_ = None
        sig, node = np.concatenate([sig, new[0]]), np.concatenate([node, new[1]])
        once = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[once], node[once]
        # The last signature may go on; one that has grown long goes out as it comes.
        cut = int(np.searchsorted(sig, sig[-1], "left"))
        if cut:
            yield whole(sig[:cut], node[:cut])
            sig, node = sig[cut:], node[cut:]
        if len(sig) > MEMORY:
            open_, last = sig[0], node[-1]
            yield rows(sig, node)
            sig = node = np.zeros(0, np.int64)
    if len(sig):
        yield whole(sig, node)


def _members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, head (the smallest member) and gid of all members of buckets of two classes or more.

    Signatures travel with half a set's key; classes that share it are all members, which verifying tells apart.
    """
    rows = sets.select(F.explode("signatures").alias("signature"), "node")
    shape = "bucket long, node long"
    sort = lambda r: r.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(_buckets, shape)
    hot = stage(rows.sample(SHARE, seed=7).groupBy("signature").count().where(F.col("count") > SHARE * HOT).select("signature"), "hot")
    if hot.isEmpty():
        found = sort(rows)
    else:
        shared = rows.join(hot, "signature", "left_semi").distinct().select(F.col("signature").alias("bucket"), "node")
        found = sort(rows.join(hot, "signature", "left_anti")).union(shared)
    members = stage(found.distinct().hint("merge").join(classes.select("node", "gid"), "node").select("bucket", "gid"), "places")
    heads = members.groupBy("bucket").agg(F.min("gid").alias("head"), F.max("gid").alias("_last")).where("head < _last").drop("_last")
    out = stage(members.hint("merge").join(heads, "bucket"), "members")
    drop(hot, members)
    return out


class RTree:
    """Points of counts in leaves of near-by points; each box is held by its upper corner and its largest set."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.leaves: list[np.ndarray] = []
        self._tile(np.arange(len(points)))
        self.corners = np.stack([points[leaf].max(0) for leaf in self.leaves])
        groups = range(0, len(self.leaves), FAN)
        self.upper = np.stack([self.corners[g : g + FAN].max(0) for g in groups])
        self.order, self.size = np.concatenate(self.leaves), np.array([len(leaf) for leaf in self.leaves])
        self.first = np.cumsum(self.size) - self.size

    def _tile(self, rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return
        own = self.points[rows]
        axis = int(np.argmax(own.max(0).astype(np.int64) - own.min(0)))
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        # Leaves stay in the order of the splits, so those of one upper box lie side by side.
        half = len(rows) // 2
        self._tile(rows[:half])
        self._tile(rows[half:])

    def reached(self, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, point) of all leaves whose sum of minima with q is at least `need`."""
        i, above = np.nonzero(np.minimum(self.upper, q[:, None]).sum(2) >= need[:, None])
        i, leaf = np.repeat(i, FAN), (above[:, None] * FAN + np.arange(FAN)).ravel()
        i, leaf = i[leaf < len(self.leaves)], leaf[leaf < len(self.leaves)]
        fits = np.minimum(self.corners[leaf], q[i]).sum(1) >= need[i]
        i, leaf = i[fits], leaf[fits]
        size = self.size[leaf]
        at = np.repeat(self.first[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(i, size), self.order[at]

    def near(self, q: np.ndarray, need: int) -> np.ndarray:
        """Points whose sum of minima with q is at least `need`."""
        rows = self.reached(q[None], np.array([need]))[1]
        return rows[np.minimum(self.points[rows], q).sum(1) >= need]


class Parities:
    """Marks of a block, folded to each length that one of them has; two are compared at the shorter one's."""

    def __init__(self, marks: list[bytes]):
        self.size = np.array([len(m) for m in marks])
        self.at, self.rows = {}, {}
        for to in np.unique(self.size):
            own = np.flatnonzero(self.size >= to)
            self.at[to] = np.zeros(len(marks), np.int64)
            self.at[to][own] = np.arange(len(own))
            self.rows[to] = folded([marks[i] for i in own], int(to))

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many groups the sets of each pair are not alike."""
        out, size = np.empty(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for to in np.unique(size):
            own, step = np.flatnonzero(size == to), max(1, TILE // int(to))
            for part in (own[low : low + step] for low in range(0, len(own), step)):
                out[part] = np.bitwise_count(self.rows[to][self.at[to][x[part]]] ^ self.rows[to][self.at[to][y[part]]]).sum(1, dtype=np.int64)
        return out


def partners(gid, n, comp, role, points, marks, low: int, high: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of a block whose bounds reach what a link needs: for each asking set the indexed ones of ranks low to high that come before it by (size, gid) and have another component, and whether one of them has more.

    Many sets ask at once: calls for one set would take longer than what they compute."""
    index = np.flatnonzero(role > 0)
    if len(index) <= low or len(np.unique(comp)) < 2:
        return
    tree = RTree(points[index])
    marks = Parities(marks)
    place = np.empty(len(gid), np.int64)
    place[np.lexsort((gid, n))] = np.arange(len(gid))
    asking = np.flatnonzero(role != 1)
    step = max(1, TILE // 16 // len(index))
    for own in (asking[at : at + step] for at in range(0, len(asking), step)):
        least = -(-percent * n[own] // 100)  # the smallest size that can link with each
        i, near = tree.reached(points[own], -(-percent * (n[own] + least) // (100 + percent)))
        i, near = own[i], index[near]
        fits = place[near] < place[i]
        i, near = i[fits], near[fits]
        fits = (comp[near] != comp[i]) & (100 * n[near] >= percent * n[i])
        i, near = i[fits], near[fits]
        fits = (100 + percent) * marks.differ(near, i) <= (100 - percent) * (n[near] + n[i])
        i, near = i[fits], near[fits]
        bound = np.minimum(points[near], points[i]).sum(1)
        fits = (100 + percent) * bound >= percent * (n[near] + n[i])
        i, near, bound = i[fits], near[fits], bound[fits]
        if not len(i):
            continue
        best = np.lexsort((gid[near], -bound, i))
        i, near = i[best], near[best]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        given = (rank >= low) & (rank < high)
        if given.any():
            yield gid[near[given]], gid[i[given]], bool((rank >= high).any())


def _ask(low: int, high: int, percent: int):
    """Pairs (a, b) of blocks; and of buckets that have more than these a row of the bucket alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], names=["a", "b", "more"])

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            bucket, block, gid, n, comp, role = (rows.column(c).to_numpy() for c in ("bucket", "block", "gid", "n", "comp", "role"))
            points, marks = points_of(rows.column("counts").to_pylist()), rows.column("parity").to_pylist()
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
            more: set[int] = set()
            held_a, held_b, count = [], [], 0
            for s, e in zip(starts, [*starts[1:], len(bucket)], strict=True):
                for a, b, rest in partners(gid[s:e], n[s:e], comp[s:e], role[s:e], points[s:e], marks[s:e], low, high, percent):
                    held_a.append(a)
                    held_b.append(b)
                    count += len(a)
                    if rest:
                        more.add(int(bucket[s]))
                    if count > 50_000:
                        yield made(held_a, held_b)
                        held_a, held_b, count = [], [], 0
            if count:
                yield made(held_a, held_b)
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(sorted(more), pa.int64())], names=["a", "b", "more"])

        # Rows come sorted by block; the last block of a batch may go on in the next.
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block = batch.column("bucket").to_numpy(), batch.column("block").to_numpy()
            last = np.flatnonzero((bucket != bucket[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            new = held and (held[-1].column("bucket")[0].as_py(), held[-1].column("block")[0].as_py()) != (int(bucket[0]), int(block[0]))
            if held and (cut or new):
                yield from out(pa.Table.from_batches([*held, batch.slice(0, cut)] if not new else held))
                if new and cut:
                    yield from out(pa.Table.from_batches([batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from out(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _bounded(percent: int):
    """Of (a, b) with both points those pairs that the bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "n", "m"))
            x, y = batch.column("parity").to_pylist(), batch.column("other_parity").to_pylist()
            both = n + m
            overlap = np.minimum(points_of(batch.column("counts").to_pylist()), points_of(batch.column("other").to_pylist())).sum(1)
            left = np.flatnonzero((100 + percent) * overlap >= percent * both)
            size = np.array([min(len(x[i]), len(y[i])) for i in left], np.int64)
            keep = np.zeros(len(a), bool)
            for to in np.unique(size):
                own = left[size == to]
                differ = np.bitwise_count(folded([x[i] for i in own], int(to)) ^ folded([y[i] for i in own], int(to))).sum(1, dtype=np.int64)
                keep[own] = (100 + percent) * differ <= (100 - percent) * both[own]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _left(asked: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs of (a, b) that the bounds leave. Points are a tenth of the texts, so most pairs end before texts are dealt out."""
    one = asked.hint("merge").join(points.withColumnRenamed("gid", "a"), "a")
    two = one.hint("merge").join(points.select(F.col("gid").alias("b"), F.col("n").alias("m"), F.col("counts").alias("other"), F.col("parity").alias("other_parity")), "b")
    sized = two.where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return stage(sized.select("a", "b", "n", "m", "counts", "other", "parity", "other_parity").mapInArrow(_bounded(percent), "a long, b long"), "left")


def _check(n: int, percent: int):
    """Of (a, b, and both texts) the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            links = np.zeros(len(a), bool)
            held: dict[int, np.ndarray] = {}
            for low in range(0, len(a), 256):
                part = range(low, min(low + 256, len(a)))
                texts = {int(a[i]): x[i] for i in part} | {int(b[i]): y[i] for i in part}
                new = [k for k in texts if k not in held]
                held = {k: held[k] for k in texts if k in held} | dict(zip(new, shingles([texts[k] for k in new], n), strict=True))
                for i in part:
                    p, q = held[int(a[i])], held[int(b[i])]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    links[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], names=["a", "b"])

    return run


def _verified(asked: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of (a, b) whose sets link. Neither side is bounded, so nothing is broadcast; Spark splits hot sets of either."""
    one = asked.hint("merge").join(texts.select(F.col("gid").alias("a"), F.col("text").alias("x")), "a")
    two = one.hint("merge").join(texts.select(F.col("gid").alias("b"), F.col("text").alias("y")), "b")
    return stage(two.select("a", "b", "x", "y").mapInArrow(_check(n, percent), "a long, b long"), "links")


def _labels(links: DataFrame) -> DataFrame:
    return links.sparkSession.createDataFrame([], "node long, component long") if links.isEmpty() else components(links)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, gid, comp and the size of the buckets whose members are in several components."""
    labelled = members.select("bucket", "gid").hint("merge").join(labels, F.col("gid") == F.col("node"), "left").select("bucket", "gid", F.coalesce("component", "gid").alias("comp"))
    several = labelled.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket", "size")
    return labelled.hint("merge").join(several, "bucket")


def _leaves(open_: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in buckets of up to LEAF sets, by sizes that may link."""
    small = open_.where(F.col("size") <= LEAF).hint("merge").join(points.select("gid", "n"), "gid").select("bucket", "gid", "comp", "n")
    other = small.select("bucket", F.col("gid").alias("b"), F.col("comp").alias("c"), F.col("n").alias("m"))
    met = small.hint("merge").join(other, "bucket").where(f"gid < b AND comp <> c AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    return stage(met.select(F.col("gid").alias("a"), "b").distinct(), "asked")


def _blocks(open_: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the blocks of open buckets. role: 2 indexed and asking, 1 indexed, 0 asking."""
    own = F.expr("cast(pmod(xxhash64(gid), nb) as int)")
    places = F.when(F.col("nb") == 1, F.array(F.struct(F.lit(0).alias("block"), F.lit(2).alias("role")))).otherwise(
        F.concat(F.array(F.struct(own.alias("block"), F.lit(1).alias("role"))), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct(b.alias("block"), F.lit(0).alias("role"))))
    )
    sized = open_.withColumn("nb", F.expr(f"cast(ceil(size / {BLOCK}) as int)"))
    placed = sized.select("bucket", "gid", "comp", F.explode(places).alias("p")).select("bucket", "p.block", "p.role", "gid", "comp")
    return placed.hint("merge").join(known, "gid").select("bucket", "block", "role", "gid", "comp", "n", "counts", "parity")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    pairs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("version"))
    full = stage(pairs.mapInArrow(_sets(n, percent), "doc_id long, version long, n_shingles long, set_key binary, counts binary, parity binary, signatures array<long>"), "sets")
    linked = "set_key IS NOT NULL AND doc_id IS NOT NULL"
    sets = stage(full.drop("signatures"), "sets")
    linkable = sets.where(linked)
    firsts = stage(linkable.groupBy("set_key").agg(F.min(F.struct("doc_id", "version")).alias("first")).select("set_key", "first.*"), "firsts")
    # A class goes by its smallest doc_id; further classes with the same one by numbers above all of these.
    top = firsts.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_key"))
    node = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long").alias("node")
    classes = firsts.withColumn("rank", rank).withColumn("gid", F.when(F.col("rank") == 1, F.col("doc_id")).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id()))
    classes = stage(classes.select("set_key", "doc_id", "version", "gid", node), "classes")
    members = _members(full.where(linked).select("signatures", node), classes)
    drop(firsts, full)
    # The texts of sets that share a bucket, once each.
    wanted = stage(members.select("gid").distinct().join(classes.select("gid", "doc_id", "version"), "gid"), "wanted")
    texts = stage(pairs.hint("merge").join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("gid", "text"), "texts")

    # Versions of one document are linked with each other.
    several = linkable.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    nodes = linkable.select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct().join(classes.select("set_key", "gid"), "set_key").select("doc_id", "gid")
    parts = [stage(nodes.join(nodes.groupBy("doc_id").agg(F.min("gid").alias("a")), "doc_id").select("a", F.col("gid").alias("b")).where("a <> b").distinct(), "links")]

    points = stage(linkable.hint("merge").join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("gid", F.col("n_shingles").alias("n"), "counts", "parity"), "points")

    def more(asked: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Labels after these pairs."""
        left = _left(asked, points, percent)
        found = _verified(left, texts, n, percent)
        drop(asked, left)
        if labels is not None and found.isEmpty():
            return labels
        parts.append(found)
        if labels is not None:
            drop(labels)
        return _labels(reduce(DataFrame.union, parts))

    heads = members.where("gid <> head").groupBy("gid", "head").count().groupBy("gid").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a"))
    labels = more(stage(heads.select("a", F.col("gid").alias("b")), "asked"), None)
    open_ = stage(_open(members, labels), "open")
    labels = more(_leaves(open_, points, percent), labels)
    drop(open_)
    large = asked_before = None
    for high in (RANKS, 1 << 60):
        held = members if large is None else members.join(large, "bucket", "left_semi")
        open_ = stage(_open(held, labels).where(F.col("size") > LEAF), "open")
        if open_.isEmpty():
            drop(open_)
            break
        blocks = _blocks(open_, points)
        # Ranks are among sets of other components, which links change: the second time all are given, and only pairs that were asked are left out.
        told = stage(blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_ask(0, high, percent), "a long, b long, more long").distinct(), "told")
        asked = told.where("a IS NOT NULL").select("a", "b")
        if asked_before is not None:
            asked = asked.join(asked_before.select("a", "b"), ["a", "b"], "left_anti")
        labels = more(stage(asked, "asked"), labels)
        if large is not None:
            drop(large, asked_before)
        large = stage(told.where("more IS NOT NULL").select(F.col("more").alias("bucket")), "large")
        asked_before = told
        drop(open_)
        if large.isEmpty():
            break
    named = classes.drop("node").join(labels, F.col("gid") == F.col("node"), "left").select("set_key", F.coalesce("component", "gid").alias("component_id"))
    with_set = linkable.select("doc_id", "n_shingles", "set_key").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    without = sets.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles")
    # An empty version goes with the others of its document.
    others = with_set.join(without.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
    out = stage(with_set.union(without.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component_id"))), "linked")
    drop(sets, classes, members, wanted, texts, points, labels, *parts, *([large, asked_before] if large is not None else []))
    return out


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that with the smallest doc_id, as one row (the smallest by its columns); columns as they came."""
    number = "__n"
    while number in docs.columns:
        number += "_"
    linked = link(docs, n=n, percent=percent)
    first = linked.where("doc_id = component_id").select("doc_id").distinct()
    # Maps and variants have no order; their JSON has.
    order = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    kept = docs.join(first.select(F.col("doc_id").alias(number)), F.col("doc_id") == F.col(number)).drop(number)
    kept = kept.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(number) == 1).drop(number)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The query's rows: all pairs that share a shingle, held to the similarity, and what is reached over these.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 4 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (n + m - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON r.other = l.a),
classes AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN classes c USING (doc_id)
"""
