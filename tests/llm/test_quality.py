import re
from collections import Counter

from pagemill.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_matches_brute_force(docs):
    rows = quality.rate(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} == {6, 9}


def test_method_counts_later_occurrences():
    found = quality.measure([" ".join("abcdefgh") + " x " + " ".join("abcdefgh"), "a b c d e f g h"])
    assert found["dup_5gram_chars"].tolist() == [8, 0]
    assert found["dup_9gram_chars"].tolist() == [0, 0]


def test_keep_returns_columns_and_empty_table(docs, no_docs):
    clash = docs.withColumnRenamed("source", "kept")
    assert quality.keep(clash).columns == clash.columns
    assert quality.keep(no_docs).count() == 0


def later(words, n):
    """Characters of words inside windows of n that are not the first of their kind."""
    met, inside = set(), set()
    for i in range(len(words) - n + 1):
        if (w := tuple(words[i : i + n])) in met:
            inside |= set(range(i, i + n))
        met.add(w)
    return sum(len(words[i]) for i in inside)


def test_verdict_matches_brute_force():
    import random

    rng = random.Random(6)
    texts = []
    for _ in range(150):
        word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 5)
        lines = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(4, 30))]
        texts.append("\n".join(rng.choice(lines) if rng.random() < rng.choice([0.0, 0.1, 0.4]) else line + " " + "".join(rng.choices("klmnopq", k=5)) for line in lines))
    found = quality.measure(texts)
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        total, met, line_chars = sum(map(len, words)), set(), 0
        for line in text.split("\n"):
            line_chars += len(re.sub(r"[\x20\x09-\x0D]", "", line)) if line in met else 0
            met.add(line)
        fits = line_chars <= quality.MAX_LINE_CHARS * total and all(later(words, n) <= share * total for n, share in quality.MAX_REPEATED.items())
        assert bool(found["kept"][i]) == (fits and not brute(text)[-1])
    assert 10 < found["kept"].sum() < 140
