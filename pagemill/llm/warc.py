"""WARC archives of pages, and their index by an external merge.

write(): each worker writes its captures, in the order of URL key and time, to one archive in the shared
folder, every record a gzip member of its own. Of records with equal payloads of MIN_REVISIT bytes or more,
that with the largest page_id is a response and the others are revisits, which hold no payload.
index(): each archive is read back and checked, and gives one sorted run of capture lines.
merge(): the runs are merged by URL key and time through loser trees. As long as there are more than FAN_IN runs, groups of
FAN_IN become one run each, a task a group. Then split points, taken from a bounded sample of the lines, deal the key
space to tasks, which open each of the last runs at their first line by a sparse index beside it. So no task
opens more than FAN_IN runs at once, and all of them open the more by the number of passes only.

Null html is an empty payload, a null url an empty key. Rows that repeat a page_id are records of their own;
of several rows with the largest page_id of a payload, each is a response. Columns other than page_id, url and html are left out.
Times, which `pages` lacks, are a fixed epoch plus page_id seconds.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, stage, table

MIN_REVISIT = 1000
FAN_IN = 64
#: Lines between two entries of a run's sparse index, and lines sampled for split points.
SPARSE, SAMPLE = 256, 4096
EPOCH = 1_704_067_200
CHUNK = 1 << 18

MANIFEST = "archive string, records long"
RUNS = "run string, url_key string, ts string, page_id long, lines long"
HISTORY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts string, archive string, record_offset long, record_length long, merge_range int, merge_pos long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what follows from them: URL key, time, digest, and the page a revisit refers to."""
    host = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")), ","), F.lit(")"), rest)
    key = F.coalesce(F.when(key.rlike(r"[^\x21-\x7E]"), F.url_encode(key)).otherwise(key), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        key.alias("url_key"),
        F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(10**9)), F.lit(0))), "yyyyMMddHHmmss").alias("ts"),
    ).withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(first, "digest").where("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left")


def _record(page_id, url: str, html: str, ts: str, digest: str, refers_to) -> bytes:
    from urllib.parse import quote

    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,-_.!~*()#%[]')}",
        f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(body)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        # The name is new for each attempt; only archives of tasks that ended are in the manifest.
        name, n, sink = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for r in batch.slice(low, 256).to_pylist():
                    if sink is None:
                        sink = store.open_output_stream(f"{where}/{name}")
                    # The URL key goes to the index by a header of the record's own gzip member.
                    raw = _record(r["page_id"], r["url"], r["html"], r["ts"], r["digest"], r["refers_to"])
                    sink.write(_member(raw.replace(b"\r\n", b"\r\nWARC-URL-Key: " + r["url_key"].encode() + b"\r\n", 1)))
                    n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives under folder; returns their manifest (archive, records)."""
    ship(pages.sparkSession)
    rows = captures(pages).sortWithinPartitions("url_key", "ts", "page_id")
    return stage(rows.mapInArrow(_write(folder), MANIFEST), "manifest")


def records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, compressed length, headers and block of each record, one in memory at a time."""
    offset, data = 0, b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        z, parts, length = zlib.decompressobj(31), [], 0
        while not z.eof:
            data = data or stream.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            length += len(data)
            parts.append(z.decompress(data))
            data = z.unused_data
        length -= len(data)
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        yield offset, length, headers, block[: int(headers["content-length"])]
        offset += length


def _urn(x: str | None) -> str:
    return "" if x is None else x[len("<urn:page:") : -1]


def _line(name: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> str:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{name}, {offset}: the payload does not match its digest")
    ts = "".join(c for c in headers["warc-date"] if c.isdigit())
    page = _urn(headers["warc-record-id"])
    return "\t".join([headers.get("warc-url-key", ""), ts, "" if page == "None" else page, str(size), digest, headers["warc-type"], _urn(headers.get("warc-refers-to")), name, str(offset), str(length)])


def _key(line: str) -> tuple[str, str, int]:
    a, b, c = line.split("\t", 3)[:3]
    return a, b, int(c or -1)


class _RunWriter:
    """Lines of a run, and beside it a sparse index: the key of each SPARSE-th line with its place."""

    def __init__(self, store, path: str):
        self.store, self.path, self.at, self.n, self.sparse = store, path, 0, 0, []
        self.sink = store.open_output_stream(path)

    def add(self, line: str) -> None:
        if self.n % SPARSE == 0:
            self.sparse.append("\t".join([str(self.at), *map(str, _key(line))]))
        raw = line.encode() + b"\n"
        self.sink.write(raw)
        self.at += len(raw)
        self.n += 1

    def close(self) -> None:
        self.sink.close()
        with self.store.open_output_stream(self.path + ".sparse") as f:
            f.write("\n".join(self.sparse).encode())


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                run_name = f"{uuid.uuid4().hex}.run"
                out, sampled, step, last = _RunWriter(store, f"{where}/{run_name}"), [], 1, None
                with store.open_input_stream(f"{where}/{name}") as f:
                    for record in records(f):
                        line = _line(name, *record)
                        key = _key(line)
                        if last is not None and key < last:
                            raise ValueError(f"{name} is not in order")
                        if out.n % step == 0:
                            sampled.append(key)
                            if len(sampled) > 2 * SPARSE:
                                sampled, step = sampled[::2], 2 * step
                        last = key
                        out.add(line)
                out.close()
                yield pa.RecordBatch.from_pydict({"run": [run_name] * len(sampled), "url_key": [k[0] for k in sampled], "ts": [k[1] for k in sampled], "page_id": [k[2] for k in sampled], "lines": [step] * len(sampled)})

    return run


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the archives back; writes a sorted run for each and returns keys of its lines (for split points; at most 512 a run, each for `lines` lines)."""
    spark = manifest.sparkSession
    ship(spark)
    names = manifest.select("archive")
    n = max(1, names.count())
    return stage(names.repartition(n, "archive").mapInArrow(_index(folder), RUNS), "runs")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, streams: list[Iterator[str]]):
        self.streams, self.k = streams, len(streams)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        line = next(self.streams[i], None)
        return None if line is None else (_key(line), line)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[str]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _lines(store, path: str, low: tuple | None, high: tuple | None) -> Iterator[str]:
    """The lines of a run from low on, below high."""
    with store.open_input_stream(path + ".sparse") as f:
        sparse = [x.split("\t") for x in f.read().decode().split("\n") if x]
    at = 0 if low is None else max(0, bisect.bisect_left([(a, b, int(c)) for _, a, b, c in sparse], low) - 1)
    if not sparse:
        return
    with store.open_input_file(path) as f:
        f.seek(int(sparse[at][0]))
        rest = b""
        while chunk := f.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            for raw in whole:
                line = raw.decode()
                key = _key(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield line


def merge_range(store, where: str, runs: list[str], low: tuple | None, high: tuple | None) -> Iterator[str]:
    """The lines of FAN_IN runs or fewer in one key range, in order."""
    yield from LoserTree([_lines(store, f"{where}/{r}", low, high) for r in runs])


def _group(folder: str):
    """One run of each FAN_IN runs of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        for names in (names for b in batches for names in b.column(0).to_pylist()):
            for low in range(0, len(names), FAN_IN):
                name = f"{uuid.uuid4().hex}.run"
                out = _RunWriter(store, f"{where}/{name}")
                for line in merge_range(store, where, names[low : low + FAN_IN], None, None):
                    out.add(line)
                out.close()
                yield pa.RecordBatch.from_pydict({"run": [name]})

    return run


def _merge(folder: str, runs: list[str], splits: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)

        def out(which: int, first: int, lines: list[str]) -> pa.RecordBatch:
            c = list(zip(*(x.split("\t") for x in lines), strict=True))
            number = lambda values: pa.array([int(v) if v else None for v in values], pa.int64())
            text = lambda values: pa.array(values, pa.string())
            columns = [number(c[2]), number(c[3]), text(c[4]), text(c[5]), number(c[6]), text(c[0]), text(c[1]), text(c[7]), number(c[8]), number(c[9]), pa.array([which] * len(lines), pa.int32()), pa.array(range(first, first + len(lines)), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in HISTORY.split(", ")])

        for batch in batches:
            for which in batch.column(0).to_pylist():
                low = splits[which - 1] if which else None
                high = splits[which] if which < len(splits) else None
                lines, done = [], 0
                for line in merge_range(store, where, runs, low, high):
                    lines.append(line)
                    if len(lines) == 5000:
                        yield out(which, done, lines)
                        done, lines = done + 5000, []
                if lines:
                    yield out(which, done, lines)

    return run


def merge(runs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """All captures, in order by (merge_range, merge_pos): by URL key, time and page_id."""
    spark = runs.sparkSession
    ship(spark)
    left = runs.select("run").distinct()
    # Groups are rows, so there are fewer runs after each pass however Spark deals these out; the last names are FAN_IN at most.
    while (n := left.count()) > FAN_IN:
        groups = -(-n // FAN_IN)
        sets = left.groupBy(F.expr(f"pmod(xxhash64(run), {groups})").alias("part")).agg(F.sort_array(F.collect_list("run")).alias("runs"))
        left = stage(sets.repartition(groups, "part").select("runs").mapInArrow(_group(folder), "run string"), "groups")
    names = sorted(r.run for r in left.collect())
    keys = runs.orderBy(F.xxhash64("run", "url_key", "ts", "page_id")).limit(SAMPLE).select("url_key", "ts", "page_id", "lines").collect()
    weighted = sorted((r.url_key, r.ts, r.page_id, r.lines) for r in keys)
    total, seen, splits = sum(w[3] for w in weighted), 0, []
    for *key, w in weighted:
        seen += w
        if seen * ranges >= (len(splits) + 1) * total and len(splits) < ranges - 1 and (not splits or tuple(key) > splits[-1]):
            splits.append(tuple(key))
    ids = spark.range(0, len(splits) + 1, 1, len(splits) + 1)
    return ids.mapInArrow(_merge(folder, names, splits), HISTORY)


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to archives, reads these back and merges their index."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    runs = index(write(pages, folder), folder)
    return merge(runs, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The query's rows, from the table itself.
ORACLE_SQL = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to FROM last
"""
