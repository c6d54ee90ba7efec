"""WARC archives and their capture index.

Pages become gzip-per-record WARC files, one row of index a record.  Each writing task sorts its index rows by
(URL key, timestamp, id) and stores them as runs of at most RUN_ROWS rows.  The runs are merged with a loser tree, by ranges of that key: a
merging task finds its range in each of its runs by binary search over their batches and then holds one batch a run, so the index is never
in memory.  More than FAN_IN runs are merged in groups to longer runs first.  The last merge gives the globally ordered capture
histories, by which records are read from their places.

Of records with equal payloads of at least `least_bytes` bytes, that with the smallest id is a response, the others are
revisits without payload, which name it; smaller payloads are always responses.

Scale: payloads are shuffled only if more than BROADCAST_DIGESTS of them occur twice or more (about 100 bytes each; the table of them is stored and
counted); then by digest and one of SALTS salts, so that a hot payload is in as many tasks.  A file is rolled at `roll_bytes`.
The driver holds a bounded sample of keys, for the bounds of ranges, and the names of runs.  Files of records and runs
have names of their attempt, which reach the next step by the rows of committed tasks only, so lost and speculative tasks do no harm.

Cases: null html is an empty payload, a null URL an empty one (key `-`); a null id sorts first, and is a response only where no page of its payload has an id;
rows that repeat the smallest id are each a response; ties of URL and time are ordered by id, ties of all three by run; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import materialise, open_fs, partitions, publish, release, slices, table, text_bytes, work_dir

EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
RUN_ROWS, RUN_BATCH, FAN_IN, RANGE_ROWS, BROADCAST_DIGESTS, SALTS, SAMPLE = 200_000, 256, 512, 1 << 20, 200_000, 16, 20_000
INDEX = "urlkey string, ts string, page_id long, file string, offset long, length long"
INDEX_SCHEMA = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: A row a batch of a run: its file, its rows and its first key.
RUN = "path string, rows long, urlkey string, ts string, page_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts string, url string"


def url_key(url: str) -> str:
    """Host labels reversed, then path and query in lower case; scheme, www. and fragment don't count."""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "") if host else url.strip().lower() or "-"


def record_bytes(page_id, url: str, when: datetime, kind: str, digest: str, size: int, payload: bytes, refers_to=None) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit has no payload but states its full length."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if kind == "response" else b""
    return gzip.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def loser_tree_merge(runs: Iterable[Iterator], key=lambda x: x) -> Iterator:
    """Merges sorted iterators; of equal keys the one of the earlier run comes first.

    Inner nodes hold the loser of their match, so each row costs one match a level from its leaf to the root.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    done = (1,)

    def pull(i: int):
        for x in sources[i]:
            return (0, key(x), i), x
        return done, None

    heads = [pull(i) for i in range(k)]
    losers: list[int] = [-1] * max(k, 1)

    def play(leaf: int) -> int:
        winner, node = leaf, (leaf + k) // 2
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = winner
                return -1
            if heads[other][0] < heads[winner][0]:
                losers[node], winner = winner, other
            node //= 2
        return winner

    winner = -1
    for leaf in range(k):
        winner = max(winner, play(leaf))
    while k and heads[winner][0] != done:
        yield heads[winner][1]
        heads[winner] = pull(winner)
        winner = play(winner)


def _capture(row) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(INDEX_SCHEMA)], schema=INDEX_SCHEMA)


def _batches(rows: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield held


def write_run(rows: Iterable[tuple], folder: str, name: str) -> pa.RecordBatch:
    """Stores sorted index rows as a file of batches; its rows of RUN."""
    made = []

    def put(out) -> None:
        with pa.ipc.new_file(out, INDEX_SCHEMA) as f:
            for held in _batches(rows, RUN_BATCH):
                f.write_batch(_index_batch(held))
                made.append((len(held), *held[0][:3]))

    path = publish(folder, name, put)
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([(path, *r)[k] for r in made], t) for k, t in enumerate(types)], [x.split()[0] for x in RUN.split(", ")])


def read_run(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run from key low on and before key high, a batch in memory at a time."""
    store, at = open_fs(path)
    with store.open_input_file(at) as source:
        f = pa.ipc.open_file(source)

        def rows(k: int, most: int | None = None) -> list[tuple]:
            b = f.get_batch(k).slice(0, most)
            return list(zip(*(c.to_pylist() for c in b.columns), strict=True))

        first = 0
        if low is not None:
            first = max(0, bisect_left(range(f.num_record_batches), low, key=lambda k: _capture(rows(k, 1)[0])) - 1)
        for k in range(first, f.num_record_batches):
            for row in rows(k):
                key = _capture(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield row


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 256 << 20, run_rows: int = RUN_ROWS, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Writes WARC files of pages (page_id, url, html) and sorted runs of their index below folder; the rows of RUN."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    firsts = materialise(firsts, "firsts")
    if firsts.count() <= broadcast_digests:
        dealt = rows.join(F.broadcast(firsts), "sha1", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "salt"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, index, files, runs = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), [], 0, 0
        pending = ((b, i) for batch in batches for b in slices(batch, "payload") for i in range(b.num_rows))
        ahead = next(pending, None)
        while ahead:
            name = f"pages-{part:06d}-{files:04d}-{attempt}.warc.gz"
            files += 1

            def put(out, name=name) -> None:
                nonlocal ahead
                at, columns, of = 0, {}, None
                while ahead and at < roll_bytes and len(index) < run_rows:
                    b, i = ahead
                    if b is not of:
                        columns, of = {c: b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "sha1")}, b
                    page_id, url, payload, first, sha1 = (columns[c][i] for c in columns)
                    url = " ".join(url.split())
                    kind = "response" if first is None or page_id == first else "revisit"
                    when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))
                    data = record_bytes(page_id, url, when, kind, base64.b32encode(bytes.fromhex(sha1)).decode(), len(payload), payload, first)
                    out.write(data)
                    index.append((url_key(url) or "-", f"{when:%Y%m%d%H%M%S}", page_id, f"{folder}/{name}", at, len(data)))
                    at += len(data)
                    ahead = next(pending, None)

            publish(folder, name, put)
            if len(index) >= run_rows or not ahead:
                yield write_run(sorted(index, key=_capture), folder, f"run-{part:06d}-{runs:04d}-{attempt}.arrow")
                index.clear()
                runs += 1
        release()

    return materialise(dealt.mapInArrow(write, RUN), "capture-runs")


def _bounds(runs: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the rows of runs into about equal ranges, from a sample of the first keys of batches."""
    share = min(1.0, max(SAMPLE, 50 * ranges) / max(1, runs.count()))
    picked = runs.where(F.xxhash64("path", "urlkey", "ts", "page_id").bitwiseAND((1 << 31) - 1) < int(share * (1 << 31))).select("urlkey", "ts", "page_id")
    keys = sorted({_capture(r) for r in picked.collect()})
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def merge_runs(runs: DataFrame, groups: list[list[str]], ranges: int) -> DataFrame:
    """Tasks (group, range) of merges, in that order: paths, and the range's keys or null."""
    bounds = [None, *_bounds(runs, ranges), None]
    key = "struct<urlkey string, ts string, known boolean, page_id bigint>"
    tasks = [(g * (len(bounds) - 1) + k, g, paths, bounds[k], bounds[k + 1]) for g, paths in enumerate(groups) for k in range(len(bounds) - 1)]
    return runs.sparkSession.createDataFrame(tasks, f"task int, grp int, paths array<string>, low {key}, high {key}").repartitionById(max(1, len(tasks)), F.col("task"))


def _merged(batch: pa.RecordBatch) -> Iterator[tuple[dict, Iterator[tuple]]]:
    for task in batch.to_pylist():
        low, high = (tuple(task[k].values()) if task[k] else None for k in ("low", "high"))
        yield task, loser_tree_merge([read_run(p, low, high) for p in task["paths"]], _capture)


def merge_index(runs: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index rows in global order of (urlkey, ts, page_id), over partitions; folder: for longer runs on the way."""
    spark = runs.sparkSession

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for b in batches:
            for task, rows in _merged(b):
                yield write_run(rows, folder, f"merged-{task['task']:08d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow")

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, rows in _merged(b):
                for held in _batches(rows, 4096):
                    yield _index_batch(held)
        release()

    while True:
        paths = sorted(r[0] for r in runs.select("path").distinct().collect())
        if not paths:
            return spark.createDataFrame([], INDEX)
        n = runs.agg(F.sum("rows")).first()[0]
        if len(paths) <= fan_in:
            return merge_runs(runs, [paths], max(partitions(spark), -(-n // range_rows))).mapInArrow(to_rows, INDEX)
        groups = [paths[k : k + fan_in] for k in range(0, len(paths), fan_in)]
        runs = materialise(merge_runs(runs, groups, 1).mapInArrow(to_runs, RUN), "longer-runs")


def read_archives(index: DataFrame) -> DataFrame:
    """Reads every indexed record from its place in its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        try:
            for b in batches:
                rows = []
                for urlkey, ts, name, at, n in zip(*(b.column(c).to_pylist() for c in ("urlkey", "ts", "file", "offset", "length")), strict=True):
                    if name not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        store, path = open_fs(name)
                        files[name] = store.open_input_file(path)
                    files[name].seek(at)
                    fields, payload = parse_record(files[name].read(n))
                    page_id, kind = fields["WARC-Record-ID"][10:-1], fields["WARC-Type"]
                    known = (len(payload), base32_sha1(payload), kind, None) if kind == "response" else (int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][5:], kind, int(fields["WARC-Refers-To"][10:-1]))
                    rows.append((int(page_id) if page_id else None, *known, urlkey, ts, fields["WARC-Target-URI"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RECORD.split(", ")])
        finally:
            for f in files.values():
                f.close()
            release()

    return index.mapInArrow(read, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "archives")
    runs = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(merge_index(runs, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
