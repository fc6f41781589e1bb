"""Language-model scores: a unigram base and context-tree weighting over bytes.

Context-tree weighting: the next byte is coded as eight binary decisions, each in a tree over the bytes
before it. Every context holds counts of zeros and ones for each of the 255 decisions and a
Krichevsky-Trofimov estimate of them; a context's weighted probability is the even mixture of its own
estimate and of the product over the contexts one byte longer. Mixed from the root down, this gives
each decision one probability that takes in all depths, and a text its code length.

Training counts all runs of DEPTH bytes and the byte after them, and all words; both tables grow with the corpus
and stay distributed. The tree has every context of up to DEPTH bytes that training met (with a SHARE above 0 those of over two bytes
that so large a share of the training bytes follow; what else follows a context is then one context more, next to its longer ones).
It is held as its runs: those that share the last three bytes before the next one lie side by side, so a task weighs them from DEPTH down to
three bytes; contexts of up to two bytes, of which there are at most 65,536, are weighed on the driver, and a second pass gives
each run the log of its last byte's probability. Runs that only held-out texts have are given theirs too.
Workers read the HEAVY_RUNS most frequent runs; all others are joined by a shuffle.
Words beyond the most frequent HEAVY ones are joined by a shuffle, so no table that grows is
sent to every worker. Texts are lower-cased in A-Z first. A null text is empty: one end token, score 0.
Repeated rows are scored (and learnt from) each for itself.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, ship, stage, table

#: Words that are looked up on the spot, and the longest of them in bytes; the rest is joined.
HEAVY, HEAVY_BYTES = 50_000, 256
#: Words that a worker counts before it hands its counts on.
FLUSH = 300_000
#: The longest context in bytes (a run has to fit 64 bits); the share of training bytes that those of over two bytes need; bytes that are looked at together.
DEPTH, SHARE, BLOCK = 5, 0.0, 1 << 22
#: Runs that are looked up on the spot at most, and those that are weighed together at least.
HEAVY_RUNS, ROWS = 1 << 21, 1 << 16


def held_out(doc_id) -> bool:
    """Of 7 documents one, by the checksum of the id as text, is kept from training."""
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _windows(raw: bytes) -> Iterator[np.ndarray]:
    """A text in blocks, each with the DEPTH bytes before it (0 before the text)."""
    padded = np.frombuffer(bytes(DEPTH) + raw, np.uint8)
    for low in range(0, len(raw), BLOCK):
        yield padded[low : low + BLOCK + DEPTH]


def _grams(window: np.ndarray) -> np.ndarray:
    """For each byte its DEPTH predecessors, the last one first, and itself, as one number: shorter contexts are its front."""
    n = len(window) - DEPTH
    out = np.zeros(n, np.int64)
    for d in [*range(DEPTH - 1, -1, -1), DEPTH]:
        out <<= 8
        out |= window[d : d + n]
    return out


def _count(id_at: int, text_at: int):
    """Rows (word, gram, n): counts of words and of grams, and (null, null, n) for the number of texts; grams of held-out texts count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        n_docs, parts, size = 0, {False: [], True: []}, {False: 0, True: 0}

        def rows(word, gram, n):
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

        def told(held: bool):
            grams, n = np.unique(np.concatenate(parts[held]), return_counts=True)
            parts[held], size[held] = [], 0
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.binary()), pa.array(grams), pa.array(n.astype(np.int64) * (not held))], names=["word", "gram", "n"])

        for batch in batches:
            for i, t in zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                raw, held = (t or "").encode().lower(), held_out(i)
                if not held:
                    n_docs += 1
                    words.update(raw.split())
                for window in _windows(raw):
                    parts[held].append(_grams(window))
                    size[held] += len(parts[held][-1])
                    if size[held] >= BLOCK:
                        yield told(held)
                if len(words) > FLUSH:
                    yield rows(list(words), [None] * len(words), list(words.values()))
                    words.clear()
        for held in parts:
            if parts[held]:
                yield told(held)
        if words:
            yield rows(list(words), [None] * len(words), list(words.values()))
        yield rows([None], [None], [n_docs])

    return run


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _log_gamma_half(a) + _log_gamma_half(b) - _log_factorial(a + b) - np.log(np.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, shifted up by 8 for accuracy."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 0.5)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 1.0)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (heap order, 1 the first bit) from counts of bytes in the last axis."""
    heap = np.zeros((*counts.shape[:-1], 512))
    heap[..., 256:] = counts
    for node in range(255, 0, -1):
        heap[..., node] = heap[..., 2 * node] + heap[..., 2 * node + 1]
    return heap[..., 2:512:2], heap[..., 3:512:2]


def _bytes_from_ones(p_one: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability, from the probability of a one in each decision."""
    heap = np.zeros((*p_one.shape[:-1], 512))
    with np.errstate(divide="ignore"):
        zero, one = np.log10(1 - p_one), np.log10(p_one)
    for node in range(1, 256):
        heap[..., 2 * node] = heap[..., node] + zero[..., node - 1]
        heap[..., 2 * node + 1] = heap[..., node] + one[..., node - 1]
    return heap[..., 256:]


def weigh(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray]:
    """Of the tree of contexts of two bytes alone, from counts of two bytes (the last one second) and the next, log10 of each next byte's probability: 256 for each context."""
    own2 = np.zeros((256, 256, 256))
    np.add.at(own2, (grams >> 8 & 255, grams >> 16, grams & 255), n)
    own1 = own2.sum(1)
    z0, o0 = _decisions(own1.sum(0))
    z1, o1 = _decisions(own1)
    kt0, kt1 = _log_kt(z0, o0), _log_kt(z1, o1)
    # Unseen contexts have no counts: their estimate and product are 1.
    below = np.zeros((256, 255))
    for b in np.flatnonzero(own1.any(1)):
        below[b] = _log_kt(*_decisions(own2[b])).sum(0)
    both = np.logaddexp(kt1, below)
    share1 = np.exp(kt1 - both)
    share0 = np.exp(kt0 - np.logaddexp(kt0, (both - np.log(2)).sum(0)))
    told1 = share0 * _guess(z0, o0) + (1 - share0) * share1 * _guess(z1, o1)
    left1 = (1 - share0) * (1 - share1)
    out = np.empty((256, 256, 256), np.float32)
    for b in range(256):
        out[:, b] = _bytes_from_ones(told1[b] + left1[b] * _guess(*_decisions(own2[b])))
    return (out.reshape(-1, 256),)


def _guess(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


class _Level:
    """Decisions under contexts of one length: a context and a place in the heap as a key, counts, the level above's row, and whether the context is in the tree."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.log = _log_kt(zeros, ones)
        self.weighted, self.share = self.log, np.ones(len(keys))

    def above(self) -> "_Level":
        """These decisions under contexts one byte shorter."""
        keys, self.parent = np.unique(self.keys >> 16 << 8 | self.keys & 255, return_inverse=True)
        return _Level(keys, np.bincount(self.parent, self.zeros, len(keys)), np.bincount(self.parent, self.ones, len(keys)))

    def inside(self, below: "_Level") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Zeros, ones and weighted logs of the contexts one byte longer that are in the tree."""
        return tuple(np.bincount(below.parent, x * below.kept, len(self.keys)) for x in (below.zeros, below.ones, below.weighted))

    def mix(self, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> None:
        """Weighs these contexts with the longer ones, and with what follows none of these."""
        zeros, ones = self.zeros - zeros, self.ones - ones
        both = np.logaddexp(self.log, weighted + _log_kt(zeros, ones))
        self.share, self.weighted, self.rest = np.exp(self.log - both), both - np.log(2), _guess(zeros, ones)

    def tell(self, told: np.ndarray | float, left: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """What contexts so long say, and how much is left to longer ones, from these figures of the shorter ones."""
        return told + left * self.share * _guess(self.zeros, self.ones), left * (1 - self.share)


def _tree(grams: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, list[_Level]]:
    """Of sorted grams, all of their contexts of three bytes, the row of each gram's eight decisions in the longest level, and levels of 3 to DEPTH bytes."""
    byte = grams & 255 | 256
    keys = np.concatenate([grams >> 8 << 8 | byte >> 8 - j for j in range(8)])
    ones = np.concatenate([byte >> 7 - j & 1 for j in range(8)]).astype(bool)
    keys, row = np.unique(keys, return_inverse=True)
    every = np.tile(n, 8)
    levels = [_Level(keys, np.bincount(row, every * ~ones, len(keys)), np.bincount(row, every * ones, len(keys)))]
    while len(levels) < DEPTH - 2:
        levels.insert(0, levels[0].above())
    for length, x in enumerate(levels, 3):
        contexts, at = np.unique(grams >> 8 * (DEPTH + 1 - length), return_inverse=True)
        total = np.bincount(at, n)
        x.kept = ((total > 0) & (total >= least))[np.searchsorted(contexts, x.keys >> 8)]
    for x, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        x.mix(*x.inside(below))
    return row, levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (gram, n) in blocks that hold all of their contexts of three bytes."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)))
        size += batch.num_rows
        if size < ROWS:
            continue
        grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(grams, grams[-1] >> 24 << 24))
        if cut:
            yield grams[:cut], n[:cut]
        # The last context may go on.
        held, size = [(grams[cut:], n[cut:])], 0
    if held and size + len(held[0][0]):
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _up(least: float):
    """For each decision under two bytes its counts, and those and the weighted logs of the contexts of three bytes in the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, n in _blocks(batches):
            first = _tree(grams, n, least)[1][0]
            two = first.above()
            columns = [two.keys, two.zeros, two.ones, *two.inside(first)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "zeros", "ones", "in_zeros", "in_ones", "weighted"])

    return run


def _top(columns: list[np.ndarray]) -> list[np.ndarray]:
    """From the sums of what _up gives, for each decision under two bytes: key, what is told, what is left to longer contexts, and the guess where there are none."""
    order = np.argsort(columns[0])
    keys, zeros, ones, *inside = (c[order] for c in columns)
    two = _Level(keys, zeros, ones)
    two.mix(*inside)
    one = two.above()
    root = one.above()
    for x, below in ((one, two), (root, one)):
        below.kept = np.ones(len(below.keys), bool)
        x.mix(*x.inside(below))
    told, left = root.tell(0.0, 1.0)
    for x in (one, two):
        told, left = x.tell(told[x.parent], left[x.parent])
    return [keys, told, left, two.rest]


def _down(least: float, path: str):
    """(gram, n, log): log10 of the probability of a gram's byte after its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *top = (_array(path, name, kind) for name, kind in zip(("keys", "told", "left", "rest"), ("<i8", "<f8", "<f8", "<f8"), strict=True))
        for grams, n in _blocks(batches):
            row, levels = _tree(grams, n, least)
            levels[0].parent = np.searchsorted(keys, levels[0].keys >> 16 << 8 | levels[0].keys & 255)
            told, left, rest = top
            for x in levels:
                told, left, rest = told[x.parent], left[x.parent], rest[x.parent]
                # Where a context is not in the tree, what follows none of the longer ones has the last word.
                ends = told + left * rest
                told, left = x.tell(told, left)
                told, left = np.where(x.kept, told, ends), np.where(x.kept, left, 0.0)
                rest = x.rest if x is not levels[-1] else rest
            p = told[row].reshape(8, -1)
            byte = grams & 255
            log = sum(np.log10(np.where(byte >> 7 - j & 1, p[j], 1 - p[j])) for j in range(8))
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64)), pa.array(log)], names=["gram", "n", "log"])

    return run


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(grams: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams and logs at their slots or the next ones that are free, at most half of them taken; -1 is none. The last entry is the slots' bits."""
    bits = max(8, (2 * len(grams)).bit_length())
    order = np.argsort(_slots(grams, bits), kind="stable")
    at = np.arange(len(order))
    if len(order):
        at = at + np.maximum.accumulate(_slots(grams[order], bits) - at)
    size = max(1 << bits, int(at.max(initial=0)) + 1) + 1
    keys, values = np.full(size + 1, -1, np.int64), np.zeros(size, np.float32)
    keys[at], values[at], keys[-1] = grams[order], logs[order], bits
    return keys, values


def _looked_up(grams: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of the logs of those grams that are held, and the others."""
    at = _slots(grams, int(keys[-1]))
    found = keys[at]
    on = np.flatnonzero((found != grams) & (found >= 0))
    while len(on):
        at[on] += 1
        found[on] = keys[at[on]]
        on = on[(found[on] != grams[on]) & (found[on] >= 0)]
    return float(logs[at].sum(dtype=np.float64)), grams[found < 0]


def _bytes(path: str, name: str) -> bytes:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{where}/{name}") as f:
        return f.read()


def _array(path: str, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(_bytes(path, name), kind)


@lru_cache(1)
def _model(path: str) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Frequent runs and words from the shared folder, read once by each worker process."""
    return _array(path, "runs", "<i8"), _array(path, "logs", "<f4"), pickle.loads(_bytes(path, "heavy"))


def _save(path: str, **files: np.ndarray | bytes) -> None:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where, recursive=True)
    for name, what in files.items():
        with store.open_output_stream(f"{where}/{name}") as f:
            f.write(what if isinstance(what, bytes) else what.tobytes())


NEW = (
    T.StructType()
    .add("held_out", T.BooleanType())
    .add("n_tokens", T.LongType())
    .add("bytes", T.LongType())
    .add("_known", T.LongType())
    .add("_log", T.DoubleType())
    .add("score", T.DoubleType())
    .add("_rest", T.ArrayType(T.StructType().add("word", T.BinaryType()).add("n", T.LongType())))
    .add("_runs", T.ArrayType(T.StructType().add("gram", T.LongType()).add("n", T.LongType())))
)


def _listed(runs: list[np.ndarray]) -> pa.ListArray:
    """Of each text its runs, once each, and how often it has them."""
    counted = [np.unique(r, return_counts=True) for r in runs]
    ends = np.cumsum([0, *(len(g) for g, _ in counted)])
    rows = pa.StructArray.from_arrays([pa.array(np.concatenate([c[k] for c in counted]), pa.int64()) for k in (0, 1)], ["gram", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _score(schema: T.StructType, id_at: int, text_at: int, path: str, n_end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *model, heavy = _model(path)
        rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            keep = [i for i in range(batch.num_columns) if i != text_at]
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                out: list[tuple] = []
                runs: list[np.ndarray] = []
                for i, t in zip(part.column(id_at).to_pylist(), part.column(text_at).to_pylist(), strict=True):
                    raw = (t or "").encode().lower()
                    tokens = raw.split()
                    found = [heavy.get(w, 0) for w in tokens]
                    c = np.array(found, np.int64)
                    known = c > 0
                    log = float(np.log10(c[known] + 1.0).sum()) + float(np.log10(n_end + 1.0))
                    rest = Counter([w for w, x in zip(tokens, found, strict=True) if not x])
                    looked = [_looked_up(_grams(window), *model) for window in _windows(raw)]
                    runs.append(np.concatenate([np.zeros(0, np.int64), *(left for _, left in looked)]))
                    out.append((held_out(i), len(tokens) + 1, len(raw), int(known.sum()) + (n_end > 0), log, sum(x for x, _ in looked), [{"word": w, "n": n} for w, n in rest.items()]))
                types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest_type]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *columns, _listed(runs)], names=schema.names)

    return run


def _runs(grams: DataFrame, path: str) -> DataFrame:
    """gram, n, log (log10 of its byte's probability) of all grams, staged; a gram with n = 0 is of held-out texts alone."""
    least = SHARE * grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = grams.repartition(F.shiftright("gram", 24)).sortWithinPartitions("gram")
    up = blocks.mapInArrow(_up(least), "key long, zeros double, ones double, in_zeros double, in_ones double, weighted double")
    # There are 255 decisions under each of 65,536 contexts at most, whatever the corpus.
    sums = up.groupBy("key").agg(*(F.sum(c).alias(c) for c in up.columns[1:])).toArrow()
    _save(path, **dict(zip(("keys", "told", "left", "rest"), _top([sums.column(c).to_numpy() for c in sums.column_names]), strict=True)))
    return stage(blocks.mapInArrow(_down(least, path), "gram long, n long, log double"), "runs")


def _most(runs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams and logs of the most frequent runs, HEAVY_RUNS at most."""
    sizes = sorted(runs.where("n > 0").groupBy("n").count().collect(), reverse=True)
    total = np.cumsum([r["count"] for r in sizes])
    fit = int(np.searchsorted(total, HEAVY_RUNS, "right"))
    if not fit:
        return np.zeros(0, np.int64), np.zeros(0)
    found = runs.where(F.col("n") >= sizes[fit - 1]["n"]).select("gram", "log").toArrow()
    return found.column("gram").to_numpy(), found.column("log").to_numpy()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte (the code length; null for an empty text)."""
    spark = docs.sparkSession
    ship(spark)
    rest = [f for f in docs.schema.fields if f.name != text]
    if clash := {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "bytes", "_row", *NEW.names} & {f.name for f in rest}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    id_at, text_at = docs.columns.index(key), docs.columns.index(text)
    pairs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    gathered = pairs.mapInArrow(_count(0, 1), "word binary, gram long, n long")
    gathered = stage(gathered.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    counts = gathered.where("word IS NOT NULL").select("word", "n")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = gathered.where("word IS NULL AND gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = total + n_docs, kinds + (n_docs > 0)
    most = counts.where(F.length("word") <= HEAVY_BYTES).orderBy(F.desc("n"), "word").limit(HEAVY).toArrow()
    heavy = dict(zip(most.column("word").to_pylist(), most.column("n").to_pylist(), strict=True))
    path = new_path(spark, "ctw")
    runs = _runs(gathered.where("gram IS NOT NULL").select("gram", "n"), path)
    grams, logs = _hashed(*_most(runs))
    _save(path, runs=grams, logs=logs, heavy=pickle.dumps(heavy))
    del grams, logs

    schema = T.StructType([*rest, *NEW.fields])
    first = docs.mapInArrow(_score(schema, id_at, text_at, path, n_docs), schema)
    # Rows are told apart by a number that is fixed once they are written.
    first = stage(first.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = first.select("_row", F.explode("_rest").alias("w")).select("_row", F.col("w.word").alias("word"), F.col("w.n").alias("tf"))
    words = rare.join(counts.withColumnRenamed("n", "c"), "word").select("_row", "tf", (F.col("tf") * F.log10(F.col("c") + 1.0)).alias("log"), F.lit(0.0).alias("score"))
    rare = first.select("_row", F.explode("_runs").alias("r")).select("_row", F.col("r.gram").alias("gram"), F.col("r.n").alias("tf"))
    bytes_ = rare.join(runs.select("gram", "log"), "gram").select("_row", F.lit(0).cast("long").alias("tf"), F.lit(0.0).alias("log"), (F.col("tf") * F.col("log")).alias("score"))
    joined = words.union(bytes_).groupBy("_row").agg(F.sum("tf").alias("_n2"), F.sum("log").alias("_log2"), F.sum("score").alias("_score2"))
    size = F.log10(F.lit(float(total + kinds + 1)))
    base = F.col("_log") + F.coalesce("_log2", F.lit(0.0)) - F.col("n_tokens") * size
    out = first.drop("_rest", "_runs").join(joined, "_row", "left").withColumn("score", F.col("score") + F.coalesce("_score2", F.lit(0.0)))
    return out.select(
        *(F.col(f"`{f.name}`") for f in rest),
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_n2", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") / F.col("bytes") * F.lit(float(np.log2(10)))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
