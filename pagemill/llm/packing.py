"""Harmonic packing of documents into sequences of a fixed number of tokens.

A document is cut into full sequences, pieces of exactly 1/k of a sequence for k = 2, 4, ... 32, and one
last piece of 65 to 127 tokens (or the whole document, if it is shorter than that). A piece of length x
belongs to the class of x: k = floor(capacity / x), and each sequence of a class takes exactly k pieces.
Which sequence a piece goes to needs only a count, so every worker fills its own sequences on the pass
that tokenises; nothing is shuffled but the few pieces of sequences that a worker could not fill.
These are numbered through for each class (by sums of counts for each worker and class) and filled in the
same way. What then is left over, at most one sequence for each class, is cut into powers of two
of the capacity, which need no padding, or run together end to end.

Every document has at least its end id, so an empty or null text is a piece of one token. Repeated rows
are packed each for itself. Other columns of the input are passed on with each piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stage, table, trim

CAPACITY = 2048
#: Pieces are not cut finer than this.
GRAIN = 64
END_ID = 1
#: Words, and parts of words, of a generation whose ids a worker remembers, and characters that are encoded at once:
#: where a worker has its memory for itself, and where it goes on from other stages. Results are the same.
ROOMY, LEAN = (200_000, 200_000, 8 << 20), (120_000, 120_000, 4 << 20)

PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]
#: Of pieces without a sequence: class, worker, number there, ids.
LOOSE = [T.StructField("_k", T.LongType()), T.StructField("_exact", T.BooleanType()), T.StructField("_worker", T.LongType()), T.StructField("_slot", T.LongType()), T.StructField("_ids", T.BinaryType())]


#: Characters that neither normal forms nor white space of other kinds touch, and the tokenizer's own parts of them.
_ODD = re.compile(r"[^\n]*[^\n\x21-\x7E\xA1-\xFF][^\n]*").findall
_LETTER, _NUMBER = r"a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF", r"0-9\xB2\xB3\xB9\xBC-\xBE"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+|\n").findall


class Memory:
    """The ids of strings met lately: two generations, of which the older goes when the younger is full; those met again stay."""

    def __init__(self, most: int, fixed: str):
        self.most, self.fixed = most, {fixed: b""}
        self.young, self.old = dict(self.fixed), {}

    def ids(self, strings: list[str], learn) -> list[bytes]:
        """learn gives the ids of those not remembered."""
        if len(self.young) > self.most:
            self.young, self.old = dict(self.fixed), self.young
        young, old = self.young, self.old
        if unmet := [s for s in strings if s not in young]:
            young.update([(s, old[s]) for s in unmet if s in old])
            if new := [s for s in unmet if s not in old]:
                young.update(zip(new, learn(new), strict=True))
        return [young[s] for s in strings]


class Words:
    """Ids of whole texts; white space is dropped by this tokenizer, so that they are those of its words one after the other.

    Words that are met for the first time are cut into the parts that the tokenizer's pattern tells apart, and these are given to its
    model many in one call, without the normal forms and the pattern that they do not need. Every part ends in an id of
    its own kind (`</w>`), which tells the parts' ids from each other.
    """

    def __init__(self, path: str, known: int = ROOMY[0], parts: int = ROOMY[1]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        steps = [{"type": "WhitespaceSplit"}, *(x for x in own["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]
        self.bare = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.parts = Memory(known, ""), Memory(parts, "\n")

    def _parts(self, new: list[str]) -> list[bytes]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def _words(self, new: list[str]) -> list[bytes]:
        """Words of printable Latin-1 characters have the ids of their parts in lower case; others are encoded whole."""
        text = "\n".join(new)
        if odd := set(_ODD(text)):
            text = "\n".join(["" if w in odd else w for w in new])
        parts = pa.array(_PARTS(text.lower() + "\n"), pa.large_string()).dictionary_encode()
        every, at = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        ids, stops = _joined(self.parts.ids(every, self._parts), at)
        raw, stops = ids.tobytes(), (4 * stops[at == every.index("\n")]).tolist()
        out = [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        if odd:
            out = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() if w in odd else x for w, x in zip(new, out, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        every = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, stops = _joined(self.known.ids(every, self._words), words.indices.to_numpy())
        raw = ids.tobytes()
        ends = (4 * np.r_[0, stops][split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        return [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _joined(own: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of own[at[0]], own[at[1]], ... one after the other, and where each ends."""
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    flat, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
    n = size[at]
    stops = np.cumsum(n)
    shift = (first[at] - (stops - n)).astype(np.int32)
    place = np.arange(stops[-1] if len(stops) else 0, dtype=np.int32)
    place += np.repeat(shift, n)
    return flat[place], stops


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, with their place."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@lru_cache(2)
def words(path: str, known: int, parts: int) -> Words:
    return Words(path, known, parts)


def cut(tokens: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """The lengths of a document's pieces, in order."""
    tail = tokens if tokens < 2 * grain and tokens % grain else grain + tokens % grain if tokens % grain else 0
    body = tokens - tail
    out = [capacity] * (body // capacity)
    body %= capacity
    size = capacity // 2
    while body:
        if body >= size:
            out.append(size)
            body -= size
        size //= 2
    return [*out, tail] if tail else out


def _worker(path: str, schema: T.StructType, text: str, end_id: int, memory: tuple[int, int, int]):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, me = words(path, *memory[:2]), TaskContext.get().partitionId()
        number = 0
        open_bins: dict[tuple[int, bool], list] = {}
        kinds = pa.schema([pa.field(f.name, t) for f, t in zip(PIECE + LOOSE, [pa.int64()] * 7 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary()], strict=True)])
        empty = None

        def out(rest: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), empty, strict=True)] if empty else []
            return pa.RecordBatch.from_arrays(columns + [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            at = batch.schema.names.index(text)
            keep = [i for i in range(batch.num_columns) if i != at]
            empty = [batch.schema.field(i) for i in keep]
            for low, texts in _chunks([t or "" for t in batch.column(at).to_pylist()], memory[2]):
                part = batch.slice(low, len(texts))
                extra = list(zip(*(part.column(i).to_pylist() for i in keep), strict=True)) if keep else [()] * part.num_rows
                rest, rows = [], []
                for more, ids in zip(extra, own.encode(texts), strict=True):
                    ids += end
                    tokens, start = len(ids) // 4, 0
                    for size in cut(tokens):
                        piece = ids[4 * start : 4 * (start + size)]
                        row = (start, size, zlib.crc32(piece), tokens)
                        start += size
                        if size == CAPACITY:
                            rest.append(more)
                            rows.append((*row, ((me + 1) << 32) + number, 0, None, None, None, None, None))
                            number += 1
                            continue
                        k, exact = CAPACITY // size, CAPACITY % size == 0
                        one = open_bins.setdefault((k, exact), [])
                        one.append((more, row, b"" if exact else piece))
                        if len(one) == k:
                            offset = 0
                            for m, r, _ in one:
                                rest.append(m)
                                rows.append((*r, ((me + 1) << 32) + number, offset, None, None, None, None, None))
                                offset += r[1]
                            number += 1
                            one.clear()
                if rows:
                    yield out(rest, rows)
        left = [(m, (*r, None, None, k, exact, me, slot, ids)) for (k, exact), one in open_bins.items() for slot, (m, r, ids) in enumerate(one)]
        if left:
            yield out([x[0] for x in left], [x[1] for x in left])
        trim()

    return run


def _end_to_end(schema: T.StructType, n_rest: int):
    """The last pieces of all, at most a sequence for each class, one after the other; cut at full sequences, and the end into powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        sizes = [CAPACITY] * ((total := sum(r[n_rest + 1] for r in rows)) // CAPACITY)
        sizes += [1 << i for i in reversed(range(CAPACITY.bit_length() - 1)) if total % CAPACITY >> i & 1]
        out, which, offset = [], 0, 0
        for r in rows:
            start, size, _, tokens = r[n_rest : n_rest + 4]
            ids, done = r[-1], 0
            while done < size:
                n = min(size - done, sizes[which] - offset)
                out.append((*r[:n_rest], start + done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), tokens, (1 << 61) + which, offset))
                done, offset = done + n, offset + n
                if offset == sizes[which]:
                    which, offset = which + 1, 0
        types = [b.type for b in _arrow(schema)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return run


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID, memory: tuple[int, int, int] = ROOMY) -> DataFrame:
    """The pieces of all documents: the other columns of docs, then start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != text]
    if clash := {f.name for f in PIECE + LOOSE} & {f.name for f in rest}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*rest, *PIECE, *LOOSE])
    final = [F.col(f"`{f.name}`") for f in rest] + [F.col(f.name) for f in PIECE]
    pieces = stage(docs.mapInArrow(_worker(path, schema, text, end_id, memory), schema), "pieces")
    placed = pieces.where("sequence_id IS NOT NULL").select(*final)

    loose = pieces.where("sequence_id IS NULL").drop("sequence_id", "offset")
    # Numbers for each worker and class; the table has a row for each of these, whatever the size of the input's rows.
    by_class = Window.partitionBy("_k", "_exact")
    counts = loose.groupBy("_k", "_exact", "_worker").agg(F.count("*").alias("_n"))
    counts = counts.select("*", (F.sum("_n").over(by_class.orderBy("_worker").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(by_class).alias("_all")).drop("_n")
    ranked = loose.join(counts, ["_k", "_exact", "_worker"]).withColumn("_rank", F.col("_before") + F.col("_slot"))
    ranked = ranked.withColumn("_bin", F.expr("_rank div _k")).withColumn("_full", F.expr("(_bin + 1) * _k <= _all"))
    # Exact pieces of the last, partial sequence of a class: as many as the binary digits of their number say go to each shorter sequence.
    inside, count = F.expr("_rank - _bin * _k"), F.expr("_all - _bin * _k")
    digit = F.lit(0)
    for b in range(CAPACITY.bit_length() - 1):
        start = F.shiftleft(F.shiftright(count, b + 1), b + 1)
        digit = F.when(~F.col("_full") & (F.shiftright(count, b).bitwiseAND(1) == 1) & (inside >= start) & (inside < start + (1 << b)), F.lit(b + 1)).otherwise(digit)
    ranked = ranked.withColumn("_digit", digit)
    named = ranked.where("_full OR _exact").withColumn(
        "sequence_id", F.lit(1 << 60) + F.shiftleft(F.col("_k") * 2 + F.col("_exact").cast("long"), 44) + F.col("_bin") * 16 + F.col("_digit")
    )
    before = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("offset", F.sum("length").over(before) - F.col("length")).select(*final)
    # At most one sequence for each of the classes, so fewer than 10,000 pieces whatever the input.
    last = ranked.where("NOT _full AND NOT _exact").select(*(F.col(f"`{f.name}`") for f in rest), *(f.name for f in PIECE[:4]), "_k", "_rank", "_ids").repartition(1).sortWithinPartitions("_k", "_rank")
    last = last.mapInArrow(_end_to_end(T.StructType([*rest, *PIECE]), len(rest)), T.StructType([*rest, *PIECE]))
    return placed.unionByName(named).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
