"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
all tokens of a piece in one pass. From the longest token at each place the encoder goes left to
right; a token may follow another only if the merges would leave the two side by side, which is a
property of the two tokens alone and is remembered. Where no token fits, it steps back once and
marks the place as dead, so the work is linear in the piece.

A null text counts as empty and encodes to no ids. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import ship, table

#: Entries that each memory of a worker may hold; it starts afresh beyond that.
MEMORY = 400_000
#: The merges never cross these places: a single space between two characters that are not blank.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.length = {v: len(k) for k, v in self.ranks.items()}
        self.packed = {v: v.to_bytes(4, "little") for v in self.bytes}
        self.shorter = {v: next((self.ranks[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in self.ranks), None) for k, v in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for k, v in self.ranks.items():
            self.automaton.add_word(k.decode("latin-1"), v)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice if it is a single byte."""
        if token not in self.halves:
            key = self.bytes[token]
            if len(key) == 1:
                self.halves[token] = (token, token)
            else:
                parts = [key[i : i + 1] for i in range(len(key))]
                while len(parts) > 2:
                    rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if rank >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                # A vocabulary entry that merges never make is a single unit here: it is no one's neighbour.
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side: undo the later merge of the two, step by step, and see whether one across them would have come first."""
        if self._halves(left)[0] < 0 or self._halves(right)[0] < 0:
            return False
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < limit:
                return False
            if self.length[left] == 1 and self.length[right] == 1:
                return True
            # The one that was merged last is taken apart; of equal ones the right.
            if left > right and self.length[left] > 1 or self.length[right] == 1:
                limit, left = left, self._halves(left)[1]
            else:
                limit, right = right + 1, self._halves(right)[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        size, longest = len(piece), [0] * len(piece)
        length, compatible, shorter = self.length, self.compatible, self.shorter
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[token] + 1] = token  # later ends are longer tokens
        alive, tokens, at, token = bytearray(b"\x01" * (size + 1)), [], 0, longest[0]
        while True:
            last = tokens[-1] if tokens else None
            while token is not None:
                if alive[end := at + length[token]]:
                    if last is None:
                        break
                    if (ok := compatible.get((last, token))) is None:
                        if len(compatible) > MEMORY:
                            compatible.clear()
                        ok = compatible[last, token] = self._fits(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token is None:
                alive[at] = 0
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte of this text")
                token = tokens.pop()
                at -= length[token]
                continue
            tokens.append(token)
            if end == size:
                return tokens
            at, token = end, longest[end]

    def _word(self, word: str) -> bytes:
        out = []
        for piece in self.find(word):
            if (ids := self.pieces.get(piece)) is None:
                if len(self.pieces) > MEMORY:
                    self.pieces.clear()
                ids = self.pieces[piece] = b"".join([self.packed[i] for i in self.encode_piece(piece.encode())])
            out.append(ids)
        ids = b"".join(out)
        if len(word) < 64:
            if len(self.words) > MEMORY:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in _CUT.split(text)]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


SCHEMA = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


def _pass(schema: T.StructType, text: str, path: str, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            at = batch.schema.names.index(text)
            rest = [i for i in range(batch.num_columns) if not digest or i != at]
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids = [own.encode(t or "") for t in part.column(at).to_pylist()]
                back = [own.decode(x) for x in ids]
                if digest:
                    new = [pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (ids, back))]
                else:
                    new = [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *new], names=schema.names)

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `ids` (little-endian unsigned 32-bit integers) and `decoded`, the bytes that these ids stand for."""
    ship(docs.sparkSession)
    if clash := set(SCHEMA.names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*docs.schema.fields, *SCHEMA.fields])
    return docs.mapInArrow(_pass(schema, text, path, pattern, False), schema)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As encode(), with the number of ids and digests in place of text, ids and bytes, which then never leave the worker."""
    ship(docs.sparkSession)
    new = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), *new.fields])
    return docs.mapInArrow(_pass(schema, text, path, pattern, True), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
