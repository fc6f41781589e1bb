import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_as_the_library(theirs):
    own, rng = bpe.encoder(PATH, public_tokenizers.PATTERN), random.Random(1)
    alphabets = ["ab", "the aoinst", "éèß 'ts", " \n\t \x1c\x85x", "0123 .,", "".join(map(chr, range(32, 700))), "東京日本 語aé😀"]
    for i in range(6000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 90)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_long_pieces_take_linear_time(theirs):
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 30_000, "ab" * 15_000, "=" * 20_001):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_table(docs, no_docs, theirs):
    rows = bpe.encode_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    texts = {(r.doc_id): r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    full = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in full)
    assert bpe.encode_digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="there already"):
        bpe.encode(docs.withColumnRenamed("lang", "ids"), PATH, public_tokenizers.PATTERN)
