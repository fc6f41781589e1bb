import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, spark, slack):
    theirs = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, own in pieces.items():
        ids = np.array([*theirs.encode(texts[doc_id][0], add_special_tokens=False).ids, 1], "<u4")
        at, copies = sorted(own, key=lambda r: r.start), len(texts[doc_id])
        assert sum(r.length for r in own) == copies * len(ids)
        assert all(r.doc_tokens == len(ids) for r in own)
        for r in at:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sorted(x for r in own for x in range(r.start, r.start + r.length)) == sorted(list(range(len(ids))) * copies)
    padding = total = 0
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
        total += end
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= slack * total, (padding, total)


def test_small(docs, spark):
    check(docs, spark, 0)


def test_many_lengths_over_several_workers(spark):
    data = [(i, " ".join(["cat"] * (i * 37 % 701 + i % 5)), "x") for i in range(900)] + [(5000, "dog " * 9000, "x")]
    check(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6), spark, 0.01)


def test_empty_and_cut(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    for n in range(1, 9000):
        sizes = packing.cut(n)
        assert sum(sizes) == n and min(sizes) >= min(n, 64)


def test_words_as_the_library():
    import random

    rng, theirs, own = random.Random(2), Tokenizer.from_file(PATH), packing.Words(PATH)
    for alphabet in ("ab'st ", "éÉßİ Ω", "\u00a6\u00ac\u00b6|~^ x", "0123 .,\n\t", "e\u0301 \u0301a\u0308 \u00a0\u2003\x1cz", "東京 日本😀 ", "\u00ad\u00b5\u00aa\u00b2\u00bd\u00d7ßÿÀ¡¿'llS "):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
