import gzip
import hashlib
import random

import pytest

from pagemill.llm import warc
from pagemill.llm.common import new_path

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(3)
    big = ["x" * 1000, "é" * 500, "y" * 999, "z" * 5000]
    rows = [(i, f"http://www.h{i % 3}.example.org/a?p={i % 11}#f", rng.choice([*big, f"own {i}" * 300])) for i in range(300)]
    return [*rows, (1000, None, None), (1001, "odd url\n\t é", ""), (1002, "http://www.h1.example.org/a?p=1", None), (7, rows[7][1], rows[7][2])]


def brute(rows):
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    return sorted((i, len(p := (h or "").encode()), hashlib.sha1(p).hexdigest(), "revisit" if last.get(h, i) != i else "response", last[h] if last.get(h, i) != i else None) for i, _, h in rows)


@pytest.mark.parametrize("fan_in", [64, 3])
def test_history_matches_brute_force(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    rows = pages()
    got = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert found == brute(rows)
    order = [(r.url_key, r.ts, r.page_id) for r in sorted(got, key=lambda r: (r.merge_range, r.merge_pos))]
    assert order == sorted(order)


def test_archives_are_gzip_members(spark):
    from pyarrow import fs

    folder = new_path(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame(pages(), SCHEMA), folder).collect()
    assert sum(r.records for r in manifest) == len(pages())
    store, where = fs.FileSystem.from_uri(folder)
    raw = store.open_input_stream(f"{where}/{manifest[0].archive}").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == manifest[0].records


def test_loser_tree():
    rng = random.Random(5)
    for k in range(9):
        runs = [sorted(f"{rng.choice('abc')}\t{rng.randrange(5)}\t{rng.randrange(9)}\t" for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_rows(spark):
    rows = [(None, "http://a.org/x", "n" * 1200, 1), (None, "http://a.org/x", "n" * 1200, 2), (5, "http://a.org/x", "n" * 1200, 3), (6, "http://a.org/y", "long " * 400_000, 4)]
    got = warc.archive(spark.createDataFrame(rows, SCHEMA + ", url_key int").repartition(2)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got) == [(0, 1200, "response"), (0, 1200, "response"), (5, 1200, "response"), (6, 2_000_000, "response")]
