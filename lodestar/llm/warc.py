"""WARC archives of pages, and a globally ordered index of their captures by external merging.

Records of equal payloads are stored once; the others refer to the stored one. Archives are read back one by one, each
giving a locally sorted run of captures (URL key, timestamp); runs are merged k at a time by a loser tree until few are
left, and then by key range, so that the merged pieces in their order are one sorted capture history.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, scratch, tidy

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000  # bytes of payload from which equal payloads are stored once
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVERY = 256  # captures of a run for each entry of its sparse index
CAPTURE = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, fragment and www, parameters sorted; '' for none."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").lower()
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return quote(url, safe="/:?=&%,()")
    host = host.removeprefix("www.")
    query = "?" + "&".join(sorted(u.query.split("&"))) if u.query else ""
    return quote(f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{query}", safe="/:?=&%,()")


def capture_time(page_id: int | None) -> str:
    """Pages carry no time; a capture's is its page_id in seconds from a fixed day, so that it is the same on every run."""
    try:
        return (EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed: an HTTP response with the payload, or a revisit with its head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if revisit else head + payload
    uri = "".join(c if c > " " else quote(c) for c in (url or "").strip())
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {capture_time(page_id)}",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member, one in memory at a time."""
    data, offset = b"", 0
    while True:
        if not data and not (data := stream.read(chunk)):
            return
        start, out, z = offset, [], zlib.decompressobj(31)
        while not z.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(data))
            offset += len(data) - len(z.unused_data)
            data = z.unused_data
        yield start, b"".join(out)


def parsed(raw: bytes, archive: str, offset: int) -> tuple:
    """The capture of one record, its payload's digest made anew."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    at = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(at["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(at["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if at["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {at['WARC-Record-ID']} of {archive} is damaged")
    return url_key(at.get("WARC-Target-URI")), at["WARC-Date"], _id(at["WARC-Record-ID"]), size, digest, at["WARC-Type"], _id(at.get("WARC-Refers-To")), archive, offset


def order(capture) -> tuple:
    """URL key, timestamp; ties by page_id (null first), then by place."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[7], capture[8]


class LoserTree:
    """k-way merge of sorted iterators: a tree of the losers of each match; the winner's source plays up one path."""

    def __init__(self, sources: Iterable[Iterator], key=order):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(self.k, 1)
        for s in range(self.k):
            self._play(s)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, s: int) -> None:
        node = (s + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = s
                return
            if self._before(other, s):
                self.losers[node], s = s, other
            node //= 2
        self.losers[0] = s

    def __iter__(self):
        while self.k and self.heads[s := self.losers[0]] is not None:
            yield self.heads[s]
            self.heads[s] = next(self.sources[s], None)
            self.keys[s] = None if self.heads[s] is None else self.key(self.heads[s])
            self._replay(s)

    def _replay(self, s: int) -> None:
        node = (s + self.k) // 2
        while node:
            if self._before(self.losers[node], s):
                self.losers[node], s = s, self.losers[node]
            node //= 2
        self.losers[0] = s


def write_run(fs, path: str, captures: Iterable[tuple]) -> tuple[int, list]:
    """Writes a run and beside it its sparse index; returns its length and the index's keys."""
    n, at, index = 0, 0, []
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for c in captures:
            if n % EVERY == 0:
                index.append([order(c), at])
            line = json.dumps(c).encode() + b"\n"
            out.write(line)
            n, at = n + 1, at + len(line)
    with fs.open_output_stream(part + ".index") as out:
        out.write(json.dumps(index).encode())
    fs.move(part + ".index", path + ".index")
    fs.move(part, path)
    return n, [k for k, _ in index]


def read_run(fs, path: str, low: tuple | None = None, high: tuple | None = None, chunk: int = 1 << 18) -> Iterator[tuple]:
    """Captures of a run with low <= key < high, streamed from the place that its sparse index names."""
    with fs.open_input_stream(path + ".index") as f:
        index = [(tuple(k), at) for k, at in json.loads(f.read())]
    first = max(bisect_left(index, (low,)) - 1, 0) if low is not None else 0
    with fs.open_input_file(path) as f:
        f.seek(index[first][1] if index else 0)
        rest = b""
        while data := f.read(chunk):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                c = tuple(json.loads(line))
                key = order(c)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield c


def stored_payloads(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, payload_bytes, and the page_id kept for payloads that occur again.

    Digests with one row, and payloads under `least` bytes, have no kept page. The join's row side may be skewed by a
    payload of very many pages; its other side has one row a digest, so Spark can split the skewed partition.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    sized = given.select("*", F.sha1(F.col("html").cast("binary")).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    again = sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("payload_digest", "kept")
    return sized.join(again, "payload_digest", "left")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, level: int = 2) -> list[str]:
    """Writes archives (a gzip member for each record) below `path`, which every executor reaches; returns their names."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        # a name of this attempt alone: a repeated task can't change an archive that was read meanwhile
        name, n = f"pages-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
        part = f"{root}/.{name}.part"
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for page, url, html, digest, size, kept in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    revisit = kept is not None and kept != page
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(record(page, url, b"" if revisit else html.encode("utf-8", "surrogatepass"), digest, size, kept, revisit)) + z.flush())
                    n += 1
        if n:
            fs.move(part, f"{root}/{name}")
        else:
            fs.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([name] * bool(n), pa.string())], ["archive"])

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    rows = stored_payloads(only(pages, "page_id", "url", "html"), least).select("page_id", "url", "html", "payload_digest", "payload_bytes", "kept")
    return sorted(r["archive"] for r in rows.mapInArrow(tidy(run), "archive string").collect())


def _table(captures: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    cols = list(zip(*captures, strict=True)) or [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, CAPTURE.split(", "), strict=True)], FIELDS)


def capture_index(spark: SparkSession, path: str, archives: list[str], fan_in: int = 64, per_range: int = 200_000) -> DataFrame:
    """Captures of all archives in one order: partitions of the result follow each other by key.

    The driver keeps a name and at most 64 keys of each run. A merging task reads at most `fan_in` runs as streams.
    """
    if not archives:
        return spark.createDataFrame([], CAPTURE + ", range_no int")

    def runs(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    captures = sorted((parsed(raw, name, at) for at, raw in members(f)), key=order)
                n, keys = write_run(fs, f"{root}/{name}.run", captures)
                keys = keys[:: -(-len(keys) // 64) or 1]
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.run"]), pa.array([n], pa.int64()), pa.array([json.dumps(keys)])], ["run", "n", "keys"])

    def merged(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                n, keys = write_run(fs, f"{root}/{row['into']}", LoserTree(read_run(fs, f"{root}/{r}") for r in row["runs"]))
                keys = keys[:: -(-len(keys) // 64) or 1]
                yield pa.RecordBatch.from_arrays([pa.array([row["into"]]), pa.array([n], pa.int64()), pa.array([json.dumps(keys)])], ["run", "n", "keys"])

    shape = "run string, n long, keys string"
    made = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(len(archives)).mapInArrow(tidy(runs), shape).collect()
    turn = 0
    while len(made) > fan_in:
        names = sorted(r["run"] for r in made)
        groups = [(f"merged-{turn}-{k:06d}.run", names[k : k + fan_in]) for k in range(0, len(names), fan_in)]
        made = spark.createDataFrame(groups, "into string, runs array<string>").repartition(len(groups)).mapInArrow(tidy(merged), shape).collect()
        turn += 1
    names, total = sorted(r["run"] for r in made), sum(r["n"] for r in made)
    keys = sorted(tuple(k) for r in made for k in json.loads(r["keys"]))
    ranges = max(1, min(len(keys), max(spark.sparkContext.defaultParallelism, -(-total // per_range))))
    cuts = [keys[len(keys) * k // ranges] for k in range(1, ranges)]
    bounds = [(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]

    def final(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                low, high = (None if x is None else tuple(x) for x in (json.loads(row["low"]), json.loads(row["high"])))
                held = []
                for c in LoserTree(read_run(fs, f"{root}/{r}", low, high) for r in names):
                    held.append(c)
                    if len(held) == 4096:
                        yield _table(held).append_column("range_no", pa.array([row["k"]] * len(held), pa.int32()))
                        held = []
                yield _table(held).append_column("range_no", pa.array([row["k"]] * len(held), pa.int32()))

    return spark.createDataFrame(bounds, "k int, low string, high string").repartitionByRange(len(bounds), "k").mapInArrow(tidy(final), CAPTURE + ", range_no int")


def capture_histories(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) to archives and returns their captures, read back and merged.

    A null html is an empty payload; a null url has the empty key. Of equal payloads of `least` bytes or more the largest
    page_id is the response (repeated rows of it too) and others revisit it; where all page_ids are null, all are
    responses. An empty table gives no archives and no rows; other columns are ignored.
    """
    path = path or scratch(pages.sparkSession, "warc")
    return capture_index(pages.sparkSession, path, write_archives(pages, path, least))


#: page_id, payload_bytes, payload_digest, record_type and refers_to in DuckDB's SQL; distinct ids are assumed.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(kept, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to FROM p LEFT JOIN k USING (payload_digest)
"""
