import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import ctw


def test_base_matches_brute_force(docs):
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in rows}
    found = ctw.score(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert (r.bits_per_byte is None) == (not texts[r.doc_id])


def test_rare_words_are_joined(docs, monkeypatch):
    every = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "HEAVY", 3)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in ctw.score(docs).collect()} == every


def _kt(a, b):
    p = 1.0
    for i in range(a):
        p *= (i + 0.5) / (i + 1)
    for j in range(b):
        p *= (j + 0.5) / (a + j + 1)
    return p


def test_weights_match_the_recursion():
    """Against the recursion written out with plain products, for one decision: the first bit."""
    raw = b"ab\xc3\xa9ba\xc3\xa9aab\xe2ab"
    seen = Counter(zip(b"\0\0" + raw, b"\0" + raw, raw, strict=False))
    keys = np.array([a << 16 | b << 8 | x for a, b, x in seen])
    model = ctw.weigh(keys, np.array(list(seen.values()), float))[0].reshape(256, 256, 256)
    assert np.allclose(np.power(10.0, model.astype(float)).sum(-1), 1, atol=1e-4)
    bits = lambda test: [sum(n for k, n in seen.items() if test(k) and k[2] >> 7 == bit) for bit in (0, 1)]
    context = (ord("a"), ord("b"))
    root, one, two = bits(lambda k: True), bits(lambda k: k[1] == context[1]), bits(lambda k: k[:2] == context)
    deep = lambda b: math_prod(_kt(*bits(lambda k, a=a: k[:2] == (a, b))) for a in range(256))
    pw = lambda b: (_kt(*bits(lambda k: k[1] == b)) + deep(b)) / 2
    s0 = _kt(*root) / (_kt(*root) + math_prod(pw(b) for b in range(256)))
    s1 = _kt(*one) / (_kt(*one) + deep(context[1]))
    p = lambda c: (c[1] + 0.5) / (sum(c) + 1)
    want = s0 * p(root) + (1 - s0) * (s1 * p(one) + (1 - s1) * p(two))
    assert abs(np.power(10.0, model[context][128:].astype(float)).sum() - want) < 1e-4


def math_prod(values):
    out = 1.0
    for v in values:
        out *= v
    return out


def test_trained_texts_cost_less_and_empty_table(docs, no_docs):
    found = {r.doc_id: r for r in ctw.score(docs).collect()}
    assert not found[9].held_out and found[9].bits_per_byte < 3 < found[5].bits_per_byte
    assert ctw.score(no_docs).count() == 0


@pytest.mark.parametrize("share", [2.0**-15, 0.06])
def test_score_of_a_text_matches_the_recursion(spark, monkeypatch, share):
    """Each bit's probability from counts under its context at each depth, mixed as the recursion says, summed over a whole text."""
    monkeypatch.setattr(ctw, "SHARE", share)
    monkeypatch.setattr(ctw, "BLOCK", 8)
    texts = dict(enumerate(["ababbababa", "ba", "Abbabaabab", "", "babbabab", "aababbab", "b", "abbabab"]))
    train = [t.lower().encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    before = lambda raw, i: tuple((bytes(5) + raw)[i : i + 5][::-1])
    seen = Counter((before(t, i), t[i]) for t in train for i in range(len(t)))
    follow = Counter()
    for (context, _), n in seen.items():
        follow.update({context[:k]: n for k in range(6)})
    longer = {c for c, n in follow.items() if len(c) > 2 and n >= share * sum(seen.values())}
    assert max(map(len, longer)) == 5 and (share > 0.01) == (len(longer) < sum(len(c) > 2 for c in follow))

    def counts(context, prefix, but=()):
        """Zeros and ones of the bit after a prefix of bits under a context, but not under others."""
        n = [0, 0]
        for (whole, byte), c in seen.items():
            bits = f"{byte:08b}"
            if whole[: len(context)] == context and whole[: len(context) + 1] not in but and bits.startswith(prefix):
                n[int(bits[len(prefix)])] += c
        return n

    def inside(context):
        """Contexts one byte longer that are in the tree, or None for a leaf."""
        if len(context) < 2:
            return [c for c in follow if len(c) == len(context) + 1 and c[:-1] == context]
        return [c for c in longer if len(c) == len(context) + 1 and c[:-1] == context] or None

    def product(context, prefix):
        kids = inside(context)
        rest = _kt(*counts(context, prefix, kids)) if len(context) >= 2 else 1.0
        return math_prod(weighted(c, prefix) for c in kids) * rest

    def weighted(context, prefix):
        own = _kt(*counts(context, prefix))
        return own if inside(context) is None else (own + product(context, prefix)) / 2

    guess = lambda n: (n[1] + 0.5) / (sum(n) + 1)

    def one(whole, length, prefix):
        context = whole[:length]
        kids, n = inside(context), counts(context, prefix)
        if kids is None:
            return guess(n)
        own = _kt(*n)
        share = own / (own + product(context, prefix))
        if whole[: length + 1] in kids or length < 2:
            return share * guess(n) + (1 - share) * one(whole, length + 1, prefix)
        return share * guess(n) + (1 - share) * guess(counts(context, prefix, kids))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in ctw.score(docs).collect():
        raw, want = texts[r.doc_id].lower().encode(), 0.0
        for i, byte in enumerate(raw):
            bits = f"{byte:08b}"
            for j in range(8):
                p = one(before(raw, i), 0, bits[:j])
                want += math.log10(p if bits[j] == "1" else 1 - p)
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-4)


def test_repeated_passages_cost_less_than_their_pairs_do(spark):
    """A long context tells what pairs of bytes leave open."""
    passage = "qa1b qa2c qa3d "
    docs = spark.createDataFrame([(i, passage * 40) for i in range(30)], "doc_id long, text string")
    assert ctw.score(docs).agg({"bits_per_byte": "max"}).first()[0] < 0.1


def _recursion(train):
    """What a text of bytes scores under the tree of all contexts of up to five bytes, weighed bottom up over dicts."""
    seen = Counter()
    for raw in train:
        padded = bytes(5) + raw
        for i, byte in enumerate(raw):
            whole, bits = padded[i : i + 5][::-1], f"{byte:08b}"
            seen.update((whole[:k], bits[: j + 1]) for k in range(6) for j in range(8))
    own = lambda context, prefix: (seen[context, prefix + "0"], seen[context, prefix + "1"])
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    weighted, product = {}, Counter()
    for context, prefix in sorted({(c, bits[:-1]) for c, bits in seen}, key=lambda x: -len(x[0])):
        log = kt(*own(context, prefix))
        if len(context) < 5:
            log = np.logaddexp(log, product[context, prefix]) - math.log(2)
        weighted[context, prefix] = log
        if context:
            product[context[:-1], prefix] += log

    def one(whole, prefix):
        told, left = 0.0, 1.0
        for k in range(6):
            a, b = own(whole[:k], prefix)
            share = 1.0 if k == 5 else math.exp(kt(a, b) - np.logaddexp(kt(a, b), product[whole[:k], prefix]))
            told, left = told + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)
        return told

    def score(raw):
        padded, total = bytes(5) + raw, 0.0
        for i, byte in enumerate(raw):
            for j in range(8):
                bits = f"{byte:08b}"
                p = one(padded[i : i + 5][::-1], bits[:j])
                total += math.log10(p if bits[j] == "1" else 1 - p)
        return total

    return score


@pytest.mark.parametrize(("runs", "rows"), [(1 << 21, 1 << 16), (50, 100)])
def test_rare_contexts_are_in_the_tree(spark, monkeypatch, runs, rows):
    """Of a corpus so large that contexts met once are under 2^-15 of it, every text scores as the whole tree says, whether its runs are at hand or joined."""
    monkeypatch.setattr(ctw, "HEAVY_RUNS", runs)
    monkeypatch.setattr(ctw, "ROWS", rows)
    rng = np.random.default_rng(3)
    rare = ["zq vxk wqz", "kxv qwz jj", "Zq vxk wqz kxv"]
    texts = ["".join(rng.choice(list("abcde é"), 2000)) + " " + rare[i % 3] for i in range(24)] + rare + ["", "zq vxk nothing like it"]
    train = [t.lower().encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(map(len, train)) > 1 << 15
    want = _recursion(train)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in ctw.score(docs).collect()}
    assert len(found) == len(texts) and any(r.held_out for r in found.values())
    for i in [*range(3), *range(24, len(texts)), next(i for i in range(24) if found[i].held_out)]:
        assert math.isclose(found[i].score, want(texts[i].lower().encode()), rel_tol=1e-6, abs_tol=1e-9)
