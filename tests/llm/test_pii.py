import hashlib
import random
import re

from pagemill.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def texts():
    rng = random.Random(1)
    pieces = ["a@b.co", "é", "x_y%z@d-e.f.g", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (988) 555-2485", "+49 30 1234567", "+1+2 345678901", " ", "\n", "..", "@", "+", "-", "12", "word", "😀", "a.", "@a.b.c"]
    out = [(i, "".join(rng.choices(pieces, k=rng.randrange(1, 14)))) for i in range(1500)]
    return [*out, (9001, None), (9002, ""), (9003, "a" * 200_000), (9004, "1 " * 60_000), (9005, "a." * 50_000 + "@b"), (9006, "a@" + "b." * 50_000), (9007, "a@b.c " * 2000), (9010, "")]


def test_base_matches_brute_force(spark):
    rows = spark.createDataFrame(texts(), "doc_id long, text string").repartition(4)
    # Texts on which the plain patterns take quadratic time have their spans written out.
    want = {9003: [], 9004: [], 9005: [], 9006: [("email", 0, 100_001)]}
    want = {i: want[i] if i in want else brute(t or "") for i, t in texts()}
    got = pii.find(rows).collect()
    assert len(got) == len(texts())
    for r in got:
        assert [tuple(s) for s in r.base] == want[r.doc_id], r.text
        assert r.spans[: len(r.base)] == r.base


def test_method_selects_likely_candidates_only(spark):
    cases = {
        1: ("please phone (030) 555-1234 today", "local_phone"),
        2: ("my SSN 123-45-6789.", "national_id"),
        3: ("IBAN: DE89 3704 0044 0532 0130 00, thanks", "iban"),
        4: ("write to jane.doe (at) example (dot) org", "masked_email"),
        5: ("password=b7db7aa4a5fcc78305 enes", "secret"),
        6: ("on 2024-01-05 and 12/11/2020", None),
        7: ("41894974608795 then 4183 and 12 400 300", None),
        8: ("version 12.10.33 pages 123-45-67", None),
        9: ("the token: word", None),
    }
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    assert got == {i: [k] if k else [] for i, (_, k) in cases.items()}


def test_features_agree_with_training(spark):
    rows = [("(030) 555-1234", "call ", " "), ("DE89 3704 0044", "x", "7"), ("a (at) b.org", "", ""), ("2020-01-02", "pages ", "a")]
    df = spark.createDataFrame(rows, "match string, before string, after string")
    from pyspark.sql import functions as F

    c = F.struct("match", "before", "after")
    got = df.select(*(f(c).cast("double").alias(n) for n, f in pii.FEATURES.items())).collect()
    assert [list(r) for r in got] == [[float(v) for v in pii._featured(*r)] for r in rows]


def test_redaction(spark, docs, no_docs):
    df = spark.createDataFrame([(1, "é a@b.co and +1 (988) 555-2485!", "x"), (2, None, "x"), (3, "plain", "x"), (4, "1.2.3.4", "x")], "doc_id long, text string, spans string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "é [EMAIL] and [PHONE]!", 2: None, 3: "plain", 4: "[IP]"}
    assert sorted(map(str, pii.redact(docs).collect())) == sorted(map(str, docs.collect()))
    assert pii.redact(no_docs).count() == 0


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.co 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:0:6,ip:7:14")
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_long_secrets_and_short_names_are_redacted_as_a_whole(spark):
    key = "9f8e7d6c5b4a3021" * 40
    rows = [(1, f"x token={key} y"), (2, "write to j (at) example (dot) org now"), (3, "write to " + "jane.doe." * 12 + "x (at) example (dot) org now")]
    rows += [(4, "token=" + "a1" * 50_000), (5, "a." * 50_000 + " (at)")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1], got[2], got[3]) == ("x [SECRET] y", "write to [MASKED_EMAIL] now", "write to [MASKED_EMAIL] now")
    assert got[4] == "[SECRET]" and got[5] == rows[4][1]
