"""The pipeline against what plain Python says of each stage."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    text = lambda: "\n".join(" ".join(word() for _ in range(20)) for _ in range(5))
    shared = "all rights reserved by the holders of this collection"
    out = [(i, text() + ("\n" + shared if i < 6 else ""), "en", "s", 1) for i in range(12)]
    out += [(20, out[8][1], "en", "s", 1), (21, out[9][1] + " end", "en", "s", 1), (22, "too short", "en", "s", 1), (23, None, None, None, None)]
    out += [(24, text() + "\nmail jane@example.org now", "en", "s", 1), (24, "x", "en", "s", 1)]
    return out, shared


def test_pipeline(spark, tmp_path):
    data, shared = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, text, *_ in data:
        if i in (20, 21, 22, 23) or text == "x":
            continue  # copies, short and null texts
        text = text.replace("jane@example.org", "[EMAIL]")
        kept[i] = text.removesuffix("\n" + shared) if 0 < i < 6 else text
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == kept.keys()
    for i, own in pieces.items():
        ids = np.array([*theirs.encode(kept[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_stages_keep_columns_and_take_empty_tables(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, "").columns == no_docs.columns, name
        assert stage(spark, no_docs, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, "").count() == 0
