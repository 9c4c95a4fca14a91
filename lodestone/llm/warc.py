"""WARC archives with revisit records, and an externally merged index of captures.

Writing. The first page of each payload (smallest id) is a response, later ones are revisits that refer to it; only ids and digests
are shuffled to find them. Every task appends gzip members to archives of its own in the shared folder and keeps the index entries
of a bounded number of records, which it sorts and writes as one run: locally sorted by URL key, timestamp and id.

Merging. Runs are merged by a loser tree, k at a time: while there are more runs than FAN_IN, groups of runs become longer runs; the
last merge is dealt out by ranges of the whole key, whose borders come from a bounded sample, so that one URL with a third of all
captures is split too. Each range reads only the row groups of a run that can hold its keys, by URL and by timestamp, and streams. Each
record is read back by offset and length. The outcome is the globally ordered capture history: capture_no numbers it from 0. Runs are
deleted once the history is written; the archives stay, as what the operator makes.

Defined cases. A null html is an empty payload. Payloads shorter than MIN_PAYLOAD are always responses. Repeated rows with the
smallest id are all responses. A null id has no order and is always a response. A null url has the empty key. An empty table has no
archives and gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_arrow, open_fs, shared_dir, written

MIN_PAYLOAD = 100
#: Entries of a run, rows of a row group, runs merged at once, keys sampled for the borders of ranges, bytes of an archive.
RUN_ENTRIES, GROUP_ROWS, FAN_IN, BORDER_SAMPLE, ARCHIVE_BYTES = 50_000, 2048, 64, 10_000, 1 << 30
#: Revisits that are broadcast to the writers; more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

_ENTRY = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RUN = "run string, entries long, sample array<struct<url_key: string, ts: string, page_id: long>>"
CAPTURE = "page_id long, url_key string, ts string, range_no long, seq long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the rest: captures of a site sort together."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.split('#')[0]}" if url else ""


def timestamp(page_id: int | None) -> str:
    """The capture time: pages carry none, so that it is one second for each id after a fixed start."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))).strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: the record's header, and for a response the payload behind minimal HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    t = timestamp(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}", f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n"
    return gzip.compress(head + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record, with the payload of a response."""
    data = gzip.decompress(member)
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = body[: int(fields["Content-Length"])]
    ident = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
    return {"type": fields["WARC-Type"], "page_id": ident(fields["WARC-Record-ID"]), "refers_to": ident(fields.get("WARC-Refers-To")),
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(fields["X-Payload-Length"]), "payload": body.partition(b"\r\n\r\n")[2]}


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, refers_to) of the records that another one's payload stands for."""
    raw = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.filter("page_id is not null").select("page_id", F.sha2(raw.cast("binary"), 256).alias("digest"), F.octet_length(raw).alias("n"))
    rows = cut(rows.filter(F.col("n") >= min_payload).select("page_id", "digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return rows.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


class _Run:
    """The entries of one run in the making."""

    def __init__(self, root: str) -> None:
        self.root, self.entries = root, []

    def write(self) -> dict:
        uri = f"{self.root}/runs/run-{uuid.uuid4().hex}.parquet"
        self.entries.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2]))
        sample = write_run(uri, iter(self.entries))
        n, self.entries = len(self.entries), []
        return {"run": uri, "entries": n, "sample": sample}


def write_run(uri: str, entries: Iterable[tuple]) -> list[dict]:
    """Writes sorted entries in row groups; returns every GROUP_ROWS-th key."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    sample, rows = [], []
    with fs.open_output_stream(path) as out, pq.ParquetWriter(out, _ENTRY, compression="zstd") as w:
        def flush() -> None:
            sample.append({"url_key": rows[0][0], "ts": rows[0][1], "page_id": rows[0][2]})
            w.write_table(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY))
            rows.clear()

        for e in entries:
            rows.append(e)
            if len(rows) == GROUP_ROWS:
                flush()
        if rows:
            flush()
    return sample


def archive(pages: DataFrame, root: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes archives and sorted runs under root; returns the written list of runs."""
    again, small = broadcast_if_small(revisits(pages, min_payload), BROADCAST_REVISITS)
    raw = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", raw.alias("html"), F.sha2(raw.cast("binary"), 256).alias("digest"))
    # beyond the broadcast both sides are shuffled by page id, which is even however many pages share a payload
    p = p.join(again, ["page_id", "digest"], "left")

    def write(pieces: Iterator[dict]) -> Iterator[dict]:
        run, out, at, name, fs, path = _Run(root), None, 0, "", None, ""
        try:
            for piece in pieces:
                for page_id, url, html, digest, first in zip(*(piece[k] for k in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0
                        fs, path = open_fs(root)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None)  # members are compressed one by one
                    member = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)
                    out.write(member)
                    run.entries.append((url_key(url), timestamp(page_id), page_id, name, at, len(member)))
                    at += len(member)
                    if len(run.entries) == RUN_ENTRIES:
                        r = run.write()
                        yield {k: [v] for k, v in r.items()}
        finally:
            if out is not None:
                out.close()
        if run.entries:
            r = run.write()
            yield {k: [v] for k, v in r.items()}

    return written(map_arrow(p.select("page_id", "url", "html", "digest", "refers_to"), write, RUN), "warc-runs")


class LoserTree:
    """k sorted streams as one: each inner node keeps the loser of its match, so that the next entry costs one path of matches."""

    def __init__(self, streams: list[Iterator[tuple]], key: Callable[[tuple], tuple]) -> None:
        self.streams, self.key, self.k = streams, key, len(streams)
        self.heads: list[tuple | None] = [next(s, None) for s in streams]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [0] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = h = next(self.streams[w], None)
            self.keys[w] = None if h is None else self.key(h)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _key(e: tuple) -> tuple:
    return (e[0], e[1], -1 if e[2] is None else e[2])


def read_run(uri: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The entries of a run with low <= key < high, one row group at a time; groups outside are not read."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            first, last = _bounds(file.metadata.row_group(g))
            if high and first > high[: len(first)]:
                return
            if low and last and last < low[: len(last)]:
                continue
            for e in zip(*(c.to_pylist() for c in file.read_row_group(g).columns), strict=True):
                k = _key(e)
                if high and k >= high:
                    return
                if not low or k >= low:
                    yield e


def _bounds(group: pq.RowGroupMetaData) -> tuple[tuple, tuple]:
    """Beginnings of keys between which a row group's keys lie: the URL key, and where it is one the timestamp too; empty if unknown."""
    stats = [group.column(i).statistics for i in (0, 1)]
    if any(s is None or not s.has_min_max for s in stats):
        return (), ()
    (a, b), (c, d) = ((s.min, s.max) for s in stats)
    return ((a, c), (b, d)) if a == b else ((a,), (b,))


def merge_runs(uris: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    return iter(LoserTree([read_run(u, low, high) for u in uris], _key))


def captures(spark: SparkSession, runs: DataFrame, root: str, fan_in: int = FAN_IN, ranges: int | None = None) -> DataFrame:
    """Merges all runs and reads every record back, in global order: (range_no, seq) numbers the captures."""
    names = [r[0] for r in runs.select("run").orderBy("run").collect()]  # files, not records: one for each RUN_ENTRIES of them
    while len(names) > fan_in:
        groups = [names[i : i + fan_in] for i in range(0, len(names), fan_in)]

        def longer(pieces: Iterator[dict], groups=groups) -> Iterator[dict]:
            for p in pieces:
                for i in p["id"]:
                    uri = f"{root}/runs/run-{uuid.uuid4().hex}.parquet"
                    write_run(uri, merge_runs(groups[i]))
                    yield {"run": [uri]}

        todo = spark.range(0, len(groups), 1, len(groups))
        names = [r[0] for r in written(map_arrow(todo, longer, "run string"), "warc-merged").collect()]
    n = ranges or max(spark.sparkContext.defaultParallelism, -(-(runs.agg({"entries": "sum"}).first()[0] or 0) // (4 * RUN_ENTRIES)))
    sample = runs.select(F.explode("sample").alias("k")).select("k.*").orderBy(F.xxhash64("url_key", "ts", "page_id")).limit(BORDER_SAMPLE)
    keys = sorted(_key(tuple(r)) for r in sample.collect())
    borders = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    edges = [None, *borders, None]

    def merge(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            for i in p["id"]:
                yield from _batches(i, merge_runs(names, edges[i], edges[i + 1]))

    return map_arrow(spark.range(0, len(edges) - 1, 1, len(edges) - 1), merge, CAPTURE)


def _batches(range_no: int, entries: Iterator[tuple], rows: int = 512) -> Iterator[dict]:
    files: dict = {}
    fields = ("page_id", "url_key", "ts", "range_no", "seq", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out: dict = {k: [] for k in fields}
    for seq, (key, ts, page_id, file, offset, length) in enumerate(entries):
        if file not in files:
            if len(files) >= 64:
                files.pop(next(iter(files))).close()
            fs, path = open_fs(file)
            files[file] = fs.open_input_file(path)
        r = parse(files[file].read_at(length, offset))
        if r["page_id"] != page_id or (r["type"] == "response" and (len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()) != (r["payload_bytes"], r["digest"])):
            raise OSError(f"{file} at {offset}: the record does not match its index entry")
        for k, v in zip(fields, (page_id, key, ts, range_no, seq, r["payload_bytes"], r["digest"], r["type"], r["refers_to"]), strict=True):
            out[k].append(v)
        if len(out["seq"]) == rows:
            yield out
            out = {k: [] for k in fields}
    for f in files.values():
        f.close()
    yield out


def histories(pages: DataFrame) -> DataFrame:
    """Archives pages and returns their merged capture history, read back from the archives, with its global number."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    history = written(captures(spark, archive(pages, root), root), "warc-history")
    fs, path = open_fs(f"{root}/runs")
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
    # one row for each range of the merge
    sizes = history.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range_no", before.alias("start"))
    return history.join(F.broadcast(starts), "range_no").withColumn("capture_no", (F.col("start") + F.col("seq")).cast("long")).drop("start", "range_no", "seq")
