import random
import re

import pytest

from pagemill.llm import common, jaccard


def brute(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, size=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    bases = [[word() for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 15, 40, 90, 200, 500]))] for _ in range(40)]
    rows = []
    for i in range(size):
        own = list(rng.choice(bases[:8] if i % 2 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append((i * 3 + 1, " ".join(w.upper() if rng.random() < 0.1 else w for w in own), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "block", "hot"), [(1, 4, 85, 4096, 1 << 40), (2, 5, 80, 4096, 1 << 40), (3, 4, 85, 5, 4)])
def test_components_match_brute_force(spark, monkeypatch, seed, n, percent, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "LEAF", 32 if block > 5 else 4)
    monkeypatch.setattr(jaccard, "RANKS", 4 if block > 5 else 1)
    monkeypatch.setattr(jaccard, "SHARE", 1.0)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs, n=n, percent=percent).collect()}
    assert got == brute(rows, n, percent)


def ranked():
    """One text (the last) near six others, and near four more that link with nothing else; ten below all of these link with nothing but are heads of most buckets."""
    base = [f"w{i}" for i in range(120)]

    def text(*places, kind="q"):
        return " ".join(f"{kind}{i}" if i in places else w for i, w in enumerate(base))

    at = [6 * (k + 1) for k in range(17)]
    rows = [text(*at[14:], kind=f"d{k}x") for k in range(10)] + [text(at[8 + k]) for k in range(6)] + [text(*at[2 * k : 2 * k + 2]) for k in range(4)] + [text()]
    return [(i + 1, t) for i, t in enumerate(rows)]


def test_partners_of_later_ranks_are_all_asked(spark, monkeypatch):
    """Links of the first ranks change components, and so the ranks of what is left."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rows = ranked()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)
    assert len({got[i][1] for i in range(11, 22)}) == 1


def test_keep_first_loses_no_partner_of_later_ranks(spark, monkeypatch):
    """As the pipeline asks: only the first of all that link is kept, and the ten that link with nothing."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rows = ranked()
    want = sorted({c for _, c in brute(rows, 5, 80).values()})
    got = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80)
    assert sorted(r.doc_id for r in got.collect()) == want == list(range(1, 12))


def test_groups_hold_every_linked_pair():
    """Sets at the very edge of linking share a signature."""
    rng = random.Random(4)
    import numpy as np

    for _ in range(1500):
        size = rng.choice([*range(1, 60), 150, 400])
        pool = np.array([rng.getrandbits(64) for _ in range(2 * size + 2)], np.uint64)
        a = size
        extra = rng.randrange(0, a // 5 + 1)
        lost = rng.randrange(0, a // 5 + 1)
        x, y = pool[:a], np.concatenate([pool[lost:a], pool[a : a + extra]])
        both = a - lost
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            assert set(jaccard.signatures(np.sort(x), 85)) & set(jaccard.signatures(np.sort(y), 85))


def test_parities_never_differ_in_more_than_the_sets():
    rng = random.Random(5)
    import numpy as np

    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(rng.choice([2, 9, 100, 3000, 20000]))], np.uint64)
        sets = [np.unique(pool[rng.randrange(len(pool) // 2) : len(pool) // 2 + 1 + rng.randrange(len(pool) // 2)]) for _ in range(3)]
        marks = [jaccard.parity(x) for x in sets]
        rows = jaccard.folded(marks, min(map(len, marks)))
        for x, a in zip(sets, rows, strict=True):
            for y, b in zip(sets, rows, strict=True):
                assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))


def test_tree_and_pairs_keep_what_the_bounds_allow():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for low, high in ((0, 4), (4, 64), (0, 1 << 60)):
        sets = [np.unique(rng.choice(rng.integers(0, 1 << 63, 60, np.uint64) if k % 9 == 0 else np.arange(90, dtype=np.uint64), rng.integers(90, 200))) for k in range(60)]
        n = np.array([len(x) for x in sets])
        gid, comp, role = rng.permutation(60), rng.integers(0, 6, 60), rng.integers(0, 3, 60)
        points, marks = jaccard.points_of([jaccard.point(x) for x in sets]), [jaccard.parity(x) for x in sets]
        assert len({len(m) for m in marks}) > 1
        differ = lambda a, b: int(np.bitwise_count(np.bitwise_xor(*jaccard.folded([a, b], min(len(a), len(b))))).sum())
        want = set()
        for i in np.flatnonzero(role != 1):
            able = []
            for j in np.flatnonzero(role > 0):
                if comp[i] != comp[j] and (n[j], gid[j]) < (n[i], gid[i]) and 100 * n[j] >= 60 * n[i]:
                    bound = int(np.minimum(points[i], points[j]).sum())
                    if 160 * bound >= 60 * (n[i] + n[j]) and 160 * differ(marks[i], marks[j]) <= 40 * (n[i] + n[j]):
                        able.append((-bound, gid[j]))
            want |= {(int(g), int(gid[i])) for _, g in sorted(able)[low:high]}
        got = {(int(x), int(y)) for a, b, _ in jaccard.partners(gid, n, comp, role, points, marks, low, high, 60) for x, y in zip(a, b, strict=True)}
        assert got == want and (want or low)
    i, j = np.triu_indices(60, 1)
    pick = lambda of, at: [of(sets[k]) for k in at]
    columns = {"a": i, "b": j, "n": n[i], "m": n[j], "counts": pick(jaccard.point, i), "other": pick(jaccard.point, j), "parity": pick(jaccard.parity, i), "other_parity": pick(jaccard.parity, j)}
    kept = {(a, b) for r in jaccard._bounded(60)(iter([pa.RecordBatch.from_pydict(columns)])) for a, b in zip(*(c.to_pylist() for c in r.columns), strict=True)}
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert (a, b) in kept or 100 * both < 60 * (len(sets[a]) + len(sets[b]) - both)
    assert 0 < len(kept) < len(i)


def test_odd_rows(docs, no_docs):
    got = jaccard.link(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1), (8, 8), (9, 9)}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert jaccard.link(no_docs).count() == 0


def test_buckets_of_streams(monkeypatch):
    """Whatever the batches, members are those of signatures of two nodes or more, repeated rows once."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for memory in (3, 1000):
        monkeypatch.setattr(jaccard, "MEMORY", memory)
        sig = np.sort(np.concatenate([rng.integers(0, 40, 90), np.full(30, 17)]))
        node = np.arange(len(sig)) * 3 - 90
        again = np.repeat(np.arange(len(sig)), rng.integers(1, 4, len(sig)))
        for size in (1, 7, 500):
            rows = [(sig[again][i : i + size], node[again][i : i + size]) for i in range(0, len(again), size)]
            batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["signature", "node"]) for x, y in rows]
            found = {}
            for b in jaccard._buckets(iter(batches)):
                for k, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found.setdefault(k, []).append(g)
            want = sorted(m for s in set(sig.tolist()) if len(m := sorted(set(node[sig == s].tolist()))) > 1)
            assert sorted(sorted(m) for m in found.values() if len(m) > 1) == want


def test_keep_first_takes_maps_and_clashing_names(spark):
    rows = [(1, "a b c d e f", {"k": "v"}, 1), (1, "a b c d e f", {"k": "u"}, 2), (2, "a b c d e f", None, 3), (3, "other words stand here now", {}, 4), (None, "x", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n map<string,string>, component_id int")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, 5), (1, 2), (3, 4)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(5, 5)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_versions_of_a_document_all_link(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(i, text("abcdef"[i - 1])) for i in range(1, 7)]
    # Document 10 has versions near to 1, 3 and 5, and none; 11 has one near to 6, and 12 nothing but empty ones.
    rows += [(10, text(k) + " end") for k in "ace"] + [(10, None), (11, text("f") + " end"), (11, text("z")), (12, None), (12, "")]
    rows += [(13, text("z") + " end"), (20, text("c"))]
    want = {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 6, 10: 1, 11: 6, 12: 12, 13: 6, 20: 1}
    for parts in (1, 5):
        got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_tree_of_several_upper_boxes_finds_all():
    """What near gives is what a scan of all points gives, so no pair that can link is passed over."""
    import numpy as np

    rng = np.random.default_rng(7)
    points = np.concatenate([rng.poisson(rng.integers(1, 9), (2500, 64)), rng.poisson(300, (40, 64))]).astype(np.int32)
    points = np.concatenate([points, np.maximum(points[:600] + rng.integers(-1, 2, (600, 64)), 0)]).astype(np.int32)
    tree = jaccard.RTree(points)
    assert len(tree.upper) > 2
    for i in rng.choice(len(points), 150, replace=False):
        for need in (1, int(0.8 * points[i].sum()), int(points[i].sum())):
            near = tree.near(points[i], need)
            assert len(near) == len(set(near.tolist()))
            assert set(near.tolist()) == set(np.flatnonzero(np.minimum(points, points[i]).sum(1) >= need).tolist())


def test_rows_without_an_id_take_no_links_away(spark):
    """A row without a doc_id that comes first in its task has the set of a later one, whose near copy must still be found."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (8, text + " end"), (None, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in jaccard.link(docs).collect()}
    assert got == {(None, None), (5, 5), (8, 5)}
    assert sorted(r.doc_id or 0 for r in jaccard.keep_first(docs).collect()) == [0, 0, 5]


def test_many_sets_ask_a_block_at_once(monkeypatch):
    """One by one, calls took longer than what they computed; and what is asked is all that the bounds leave."""
    import numpy as np

    rng = np.random.default_rng(8)
    x = []
    for _ in range(300):
        if x and rng.random() < 0.5:
            own = x[rng.integers(len(x))]
            x.append(np.unique(np.r_[own[rng.random(len(own)) > 0.05], rng.integers(0, 1 << 62, 2).astype(np.uint64)]))
        else:
            x.append(np.unique(rng.integers(0, 1 << 62, int(rng.integers(20, 300))).astype(np.uint64)))
    n, gid = np.array([len(s) for s in x]), rng.permutation(900)[:300]
    comp, role = np.where(rng.random(300) < 0.2, 7, gid), rng.choice([0, 1, 2], 300)
    points, marks = jaccard.points_of([jaccard.point(s) for s in x]), [jaccard.parity(s) for s in x]
    parities = jaccard.Parities(marks)

    def possible(i, j):
        both = n[i] + n[j]
        if role[i] == 1 or role[j] == 0 or comp[i] == comp[j] or (n[j], gid[j]) >= (n[i], gid[i]) or 100 * n[j] < 80 * n[i]:
            return False
        return 180 * np.minimum(points[i], points[j]).sum() >= 80 * both and 180 * parities.differ(np.array([j]), np.array([i]))[0] <= 20 * both

    want = {(gid[j], gid[i]) for i in range(300) for j in range(300) if possible(i, j)}
    assert len({b for _, b in want}) > 20
    for tile, parts in ((1 << 22, 1), (1 << 10, 300)):
        monkeypatch.setattr(jaccard, "TILE", tile, raising=False)
        got = list(jaccard.partners(gid, n, comp, role, points, marks, 0, 1 << 60, 80))
        assert len(got) <= parts and not any(rest for _, _, rest in got)
        assert {(a, b) for x, y, _ in got for a, b in zip(x, y, strict=True)} == want
