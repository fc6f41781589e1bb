from pagemill.llm import lines


def body(i):
    own = "abcdefgh"[i]
    return " ".join(own + w for w in "one two three four five six seven eight nine".split()) + "\n" + " ".join(own + w for w in "red green blue pink grey black white teal gold navy".split())


def test_recurring_templates_go_but_for_the_first(spark):
    shared = [f"Copyright {2000 + i} by the Example Press of Town" for i in range(6)]
    # Three words vary without digits: generalised by the leaf.
    named = [f"page was printed for {n} on the old machine there" for n in ("anna", "bert", "carl", "dora", "emil", "fritz")]
    rows = [(i, "\n".join([body(i), shared[i], named[i]])) for i in range(6)]
    rows += [(10, "only two words\nshort"), (11, None), (12, ""), (13, shared[0]), (None, shared[0])]
    got = {r.doc_id: r for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 6):
        assert got[i].text == body(i) and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    # Whatever the share; rows without an id stay as they are.
    assert got[13].text == "" and got[13].n_dropped == 1 and got[None].text == shared[0]
    assert got[11].text is None and got[11].n_lines == 0 and got[12].n_lines == 1


def test_two_documents_are_too_few_and_columns_stay(spark, docs, no_docs):
    rows = [(i, body(i) + "\nthis line is in two documents only", "x") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = lines.clean(df)
    assert {r.doc_id: r.text for r in got.collect()} == {r[0]: r[1] for r in rows}
    assert lines.clean(docs).count() == docs.count()
    assert lines.clean(no_docs).count() == 0


def test_masks(spark):
    from pyspark.sql import functions as F

    raw = ["a1 b  c\t2d", "no digits  here ", " 12:30 x", ""]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(lines._masked(F.col("r")).alias("m"))
    assert [r.m for r in got.collect()] == ["<*> b c <*>", "no digits here", "<*> x", ""]


def test_pipeline_drops_whatever_the_share_but_spares_near_copies(spark):
    import corpus_pipeline

    shared = "Copyright by the Example Press of Town and all that belongs to it"
    rows = [(i, body(i) + "\n" + shared, "en", "s", 1) for i in range(4)]
    # Mostly boilerplate, but no copy; then three copies of one text of which the first stays and two are spared.
    rows += [(10, "a few own words\n" + shared, "en", "s", 1)] + [(i, body(7), "en", "s", 1) for i in (20, 21, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: rows[0][1], **{i: body(i) for i in (1, 2, 3)}, 10: "a few own words", **{i: body(7) for i in (20, 21, 22)}}


def test_pipeline_drops_long_lines_of_two_documents_and_frequent_short_ones(spark):
    import corpus_pipeline

    long = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("x", "y", "z", "u", "v", "w", "t"))
    rows = [(i, body(i) + "\n" + long, "en", "s", 1) for i in range(2)]
    rows += [(10 + i, f"{body(i % 8)} {'only' * (i + 1)}\nAll rights reserved.\n12 45 {i}" + ("\ntwo words" if i < 30 else ""), "en", "s", 1) for i in range(22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert long in got[0] and long not in got[1]
    # Three words in 22 documents go; two words in as many and rows of numbers stay.
    assert [i for i in got if "All rights reserved." in got[i]] == [10]
    assert all("two words" in got[10 + i] and f"12 45 {i}" in got[10 + i] for i in range(22))


def test_pipeline_finds_several_templates_in_a_leaf(spark):
    import corpus_pipeline

    names = ["anna", "bert", "carl", "dora", "emil", "fritz", "gerd", "hans"]
    said = [f"This page was {x} {n} {y}" for x, y in (("written by", "today"), ("moved to", "yesterday")) for n in names[:4]]
    said += ["This page was once a green garden", "This page was never any red lake"]
    rows = [(i, body(i % 8) + " " + "own" * (i + 1) + "\n" + line, "en", "s", 1) for i, line in enumerate(said)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    # Of each of the two templates the first stays; so do lines of neither.
    assert [i for i, line in enumerate(said) if line in got[i]] == [0, 4, 8, 9]


def brute(rows):
    """The kept text of each (doc_id, text), from the rules in plain Python."""
    from collections import Counter, defaultdict

    lines = [(d, t, i, ["<*>" if any(c in "0123456789" for c in w) else w for w in x.split()]) for d, t in set(rows) if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if any(w != "<*>" for w in x[3])]
    leaves = defaultdict(list)
    for x in lines:
        leaves[len(x[3]), *x[3][:3]].append(x)
    template = {}

    def deal(group, total):
        fixed = [next((w for w, n in Counter(x[p] for x in group).items() if 2 * n > total), None) for p in range(len(group[0]))]
        rest = []
        for x in set(group):
            same = [w == f for w, f in zip(x, fixed, strict=True)]
            if sum(same) >= 0.7 * len(x):
                named = tuple(w if s else "<*>" for w, s in zip(x, same, strict=True))
                template[x] = named if any(w != "<*>" for w in named) else x
            else:
                rest.append(x)
        held, kinds = Counter((p, w) for x in group if x in rest for p, w in enumerate(x)), Counter((p, w) for x in rest for p, w in enumerate(x))
        parts = defaultdict(list)
        for x in rest:
            able = [(held[p, w], -p, w) for p, w in enumerate(x) if 2 * held[p, w] <= total and kinds[p, w] > 1]
            if able:
                parts[max(able)[1:]].append(x)
            else:
                template[x] = x
        for part in parts.values():
            every = [x for x in group if x in part]
            deal(every, len(every))

    for own in leaves.values():
        if len({x[0] for x in own}) > 1:
            deal([tuple(x[3]) for x in own], len(own))
    found = defaultdict(set)
    for d, t, i, x in lines:
        if tuple(x) in template:
            found[template[tuple(x)]].add((d, i, t))
    gone = set()
    for named, at in found.items():
        n = len(named)
        if len({d for d, *_ in at}) >= {1: 80, 2: 40, 3: 20}.get(n, 2 if n > 50 else 3):
            first = min((d, i) for d, i, _ in at)
            gone |= {x for x in at if x[:2] != first}
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i, t) not in gone) for d, t in set(rows)}


def test_random_documents_match_brute_force(spark):
    import random

    rng = random.Random(11)
    word = lambda: rng.choice(["red", "green", "blue", "tree", "lake", "a1", "22", "on", "to"])
    forms = ["sold by {} today", "moved to {} now", "Copyright {} Example Press", "page {} of {} here", "{} {} {} {}", "written by {} {} for the {} of towns", "All rights reserved.", "Share", "{}", "the cat {} on the {} mat and {} slept", "x " * 60 + "{}"]
    rows = []
    for d in range(130):
        text = "\n".join(_fill(rng.choice(forms), word) for _ in range(rng.randrange(0, 9)))
        rows.append((d // 2 if d % 10 == 0 else d, text))
    rows += [(3, None), (4, ""), (5, " \t"), rows[0], (500, "\n".join(["long " * 3000 + w for w in ("x", "y", "z")])), (501, "long " * 3000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    got = lines.clean(df.withColumn("was", df.text)).collect()
    assert len(got) == len(rows) and all(r.text == want[r.doc_id, r.was] for r in got)
    assert sum(r.n_dropped for r in got) > 100


def _fill(form, word):
    while "{}" in form:
        form = form.replace("{}", word(), 1)
    return form.strip()


def test_clash_is_told(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_lines long")
    with pytest.raises(ValueError, match="prefix"):
        lines.clean(df)
    assert lines.clean(df.withColumn("__lines", df.n_lines), prefix="p_").columns == ["doc_id", "text", "n_lines", "__lines", "p_n_lines", "p_n_dropped"]


def test_texts_of_a_round_do_not_outlive_it(spark, monkeypatch):
    """A leaf of several rounds: never more than three staged tables that hold lines."""
    live, most, rounds = set(), [], []
    stage, drop = lines.stage, lines.drop

    def staged(df, name):
        out = stage(df, name)
        if "masked" in df.columns:
            live.add(out._staged_at)
            most.append(len(live))
        rounds.append(name)
        return out

    def dropped(*tables):
        for t in tables:
            live.discard(vars(t).get("_staged_at"))
        drop(*tables)

    monkeypatch.setattr(lines, "stage", staged)
    monkeypatch.setattr(lines, "drop", dropped)
    kinds = [" ".join(f"{a}{w}" for w in "klmnopqr") for a in "abcdefgh"]
    rows = [(i, "\n".join(f"the same start {k} w{chr(97 + i)}" for k in kinds[: 8 - i])) for i in range(6)]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) > 0 and rounds.count("named") > 2
    assert max(most) <= 3 and not live


def test_dealing_takes_no_texts_along_with_tokens(spark, monkeypatch):
    """Where groups are dealt out, an exchange of tokens has no line beside each of them: lines would be written as often as they have tokens."""
    plans = []
    stage = lines.stage

    def staged(df, name):
        if name in ("dealt", "copies"):
            plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(lines, "stage", staged)
    kinds = [" ".join(f"{a}{w}" for w in "klmnopqr") for a in "abcdefgh"]
    rows = [(i, "\n".join(f"the same start {k} w{chr(97 + i)}" for k in kinds[: 8 - i])) for i in range(6)]
    lines.clean(spark.createDataFrame(rows, "doc_id long, text string"), spare=True).collect()
    dealt = [p for name, p in plans if name == "dealt"]
    assert dealt
    for plan in dealt:
        for line in plan.splitlines():
            # What leaves a generator of tokens, or is joined and grouped by token, holds hashes alone.
            assert not ("Aggregate [" in line and "masked" in line), line
