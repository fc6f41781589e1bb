"""Quality rules: characters inside repeated n-grams and lines, by rolling hashes of several lengths.

Words are runs of characters other than space and \\x09-\\x0D. A text that is null counts as
empty: all its measures are 0 and it fails the base rule (fewer than 50 words). Repeated rows are
measured each for itself; columns of the input other than its text are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table, trim

#: Lengths of the n-grams whose repetition is measured, each with the share of a text's
#: characters that may lie in later occurrences of its n-grams.
MAX_REPEATED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The share of a text's characters that may lie in lines equal to an earlier line.
MAX_LINE_CHARS = 0.30
MIN_WORDS = 50
#: Bytes of text that are measured at once.
BLOCK = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("dup_line_chars", T.LongType()),
        *(T.StructField(f"dup_{n}gram_chars", T.LongType()) for n in MAX_REPEATED),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def _in_repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _later(keys: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Of the repeated positions, those that are not the first of their key."""
    places = np.flatnonzero(repeated)
    order = places[np.argsort(keys[places], kind="stable")]
    first = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.zeros(0, bool)
    out = repeated.copy()
    out[order[first]] = False
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for words inside one of the windows of n words that begin where starts is true."""
    depth = np.zeros(size + 1, np.int32)
    depth[: len(starts)] += starts
    depth[n : len(starts) + n] -= starts
    return np.cumsum(depth[:size]) > 0


def _exact_keys(ids: np.ndarray, total: int) -> np.ndarray:
    """One integer for each window of 3 ids, equal only for equal windows."""
    pair = ids[:-2] * total + ids[1:-1]
    if total > 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * total + ids[2:]


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    raw = [t.encode() for t in texts]
    n_docs = len(raw)
    ids: list[int] = []
    counts, bases, base = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), 0
    dup_lines, dup_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i, b in enumerate(raw):
        words = b.split()
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, len(seen)) for w in words]
        counts[i], bases[i] = len(words), base
        base += len(seen)
        lines = texts[i].split("\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            met = set()
            for line in lines:
                if line in met:
                    if line.strip(" \t\n\x0b\x0c\r"):
                        dup_lines[i] += 1
                        dup_chars[i] += len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
                else:
                    met.add(line)
    doc = np.repeat(np.arange(n_docs), counts)
    # No id is used in two texts, so no window equals one of another text.
    x = np.array(ids, np.int64) + np.repeat(bases, counts)
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    ends = np.cumsum([len(b) + 1 for b in raw])
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    length = chars[edge[1::2]] - chars[edge[::2]]
    symbols = np.flatnonzero(_SYMBOL[data])
    total = np.bincount(doc, length, n_docs).astype(np.int64)
    out = {"n_words": counts, "word_chars": total, "n_symbols": np.bincount(np.searchsorted(ends, symbols, "right"), minlength=n_docs), "n_dup_lines": dup_lines, "dup_line_chars": dup_chars}
    size = len(x)
    same = lambda n: doc[n - 1 :] == doc[: size - n + 1]
    if size >= 3:
        found = _in_repeats(_exact_keys(x, max(1, base))) & same(3)
        out["n_repeat_words"] = np.bincount(doc, _covered(found, 3, size), n_docs).astype(np.int64)
    else:
        out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    # Rolling polynomial hashes modulo 2**64 of mixed word ids: each length is one step from the one before.
    mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled, prime = mixed.copy(), np.uint64(0xD6E8FEB86659FD93)
    for n in range(2, max(MAX_REPEATED) + 1):
        if size < n:
            rolled = rolled[:0]
        else:
            rolled = rolled[: size - n + 1] * prime + mixed[n - 1 :]
        if n in MAX_REPEATED:
            inside = np.zeros(n_docs)
            if len(rolled) and (again := _in_repeats(rolled) & same(n)).any():
                inside = np.bincount(doc, _covered(_later(rolled, again), n, size) * length, n_docs)
            out[f"dup_{n}gram_chars"] = inside.astype(np.int64)
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * counts)
    kept = ~out["base_failed"] & (dup_chars <= MAX_LINE_CHARS * total)
    for n, share in MAX_REPEATED.items():
        kept &= out[f"dup_{n}gram_chars"] <= share * total
    out["kept"] = kept
    return out


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _run(column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(batch.schema.names.index(column)).to_pylist()
            for block in _blocks(texts):
                found = measure(block)
                rest = [batch.column(i).slice(at, len(block)) for i in range(batch.num_columns)]
                kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.int64() for f in MEASURES]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(found[f.name], k) for f, k in zip(MEASURES, kinds, strict=True))], names=names)
                at += len(block)
        trim()

    return run


def rate(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measures and the verdict `kept` of each text; prefix keeps them apart from columns of the same name."""
    ship(docs.sparkSession)
    new = [T.StructField(prefix + f.name, f.dataType) for f in MEASURES]
    if clash := {f.name for f in new} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    schema = T.StructType([*docs.schema.fields, *new])
    return docs.mapInArrow(_run(text, schema.names), schema)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return rate(docs, text, "__quality_").where("__quality_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs).drop("text")


def _later_sql(n: int) -> str:
    """Characters of words in windows of n words that are not the first of their kind in the text."""
    return f"""r{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS nth FROM (SELECT doc_id, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS k, unnest(range(1, len(w) - {n - 2})) AS i FROM texts)),
c{n} AS (SELECT doc_id, sum(length(word))::BIGINT AS dup_{n}gram_chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM r{n} WHERE nth > 1) JOIN words USING (doc_id, i) GROUP BY doc_id)"""


#: The query's rows.
ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM texts)),
again AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM lines WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
threes AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS k, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM threes WHERE n > 1) GROUP BY doc_id),
{", ".join(_later_sql(n) for n in MAX_REPEATED)},
measures AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in MAX_REPEATED)}
  FROM texts LEFT JOIN again USING (doc_id) LEFT JOIN repeated USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in MAX_REPEATED)}),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT *, NOT base_failed AND dup_line_chars <= {MAX_LINE_CHARS}::DOUBLE * word_chars AND {" AND ".join(f"dup_{n}gram_chars <= {share}::DOUBLE * word_chars" for n, share in MAX_REPEATED.items())} AS kept FROM base
"""
