"""WARC archives of pages, and their index by an external merge.

Pages go to archives task by task, a gzip member a record; each task also leaves a run of index lines, sorted by URL key and
time in memory-bounded pieces. Merge tasks take a range of keys each, read that range of every run (found by the runs' sparse
indexes, which lie beside them) and merge the runs with a tree of losers, FAN_IN at a time, into globally ordered capture histories.
Records are read back by that index: each line names the archive, offset and length of its record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, scratch, small_batches
from .tokens import open_path

#: Captures have no time of their own in pages: page n counts as fetched n seconds after this, unless the caller names a column of times.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Index lines that a task sorts at once, and lines between two entries of a run's sparse index.
RUN_LINES, SPARSE = 200_000, 256
#: Keys of a run that the driver cuts ranges by, runs that are merged at a time, and index lines whose records are read at a time.
CUTS, FAN_IN, READ_LINES = 8, 64, 5_000


def url_key(url: str | None) -> str:
    """A sort-friendly URL: host labels reversed, port and path after it; scheme, www., fragment and case of the host don't count. White space is escaped."""
    return re.sub(r"\s", lambda m: quote(m[0]), _url_key(url))


def _url_key(url: str | None) -> str:
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return f"?){(url or '').strip()}"
    host = re.sub(r"^www\d*\.", "", host)
    tail = u.path or "/"
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port and port not in (80, 443) else ''}){tail}{f'?{u.query}' if u.query else ''}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, date: str, digest: str, payload: bytes, size: int, page_id: str, refers: tuple[str, str, str] | None, place: str) -> bytes:
    """A record as one gzip member, its id made from its place. A revisit has only the HTTP head; its payload is that of the record it refers to by page, URL and date."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(body)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2]), ("WARC-Truncated", "length")]
    head.append(("Content-Length", str(len(body))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 4, mtime=0)


def _one_line(v: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", v or "")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream."""
    held, at = b"", 0
    while True:
        if not held and not (held := stream.read(1 << 20)):
            return
        unzip, out, length = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise ValueError("an archive ends within a record")
            out.append(unzip.decompress(held))
            length += len(held) - len(unzip.unused_data)
            held = unzip.unused_data
        yield at, length, b"".join(out)
        at += length


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header fields, its HTTP head and its payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            if self.tree[at] == -1:
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (best := self.head[w := self.tree[0]]) is not None:
            yield best
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def write_run(lines: Iterable[tuple], path: str) -> tuple[int, list[str]]:
    """Sorted index lines as a file, with its sparse index, (key, offset) of every SPARSE-th line, beside it; returns the number of lines and up to CUTS keys."""
    n, at, sparse = 0, 0, []
    with open_path(path, "wb") as out:
        for line in lines:
            if n % SPARSE == 0:
                sparse.append((line[0], at))
            data = json.dumps(line).encode() + b"\n"
            out.write(data)
            n, at = n + 1, at + len(data)
    with open_path(f"{path}.sparse", "wb") as out:
        out.write(json.dumps(sparse).encode())
    return n, [sparse[len(sparse) * i // CUTS][0] for i in range(min(CUTS, len(sparse)))]


def read_run(path: str, low: str | None = None, high: str | None = None) -> Iterator[tuple]:
    """Lines of a run with low <= key < high, read in pieces from the last entry of its sparse index before low."""
    start = 0
    if low is not None:
        with open_path(f"{path}.sparse") as stream:
            sparse = json.loads(stream.read())
        start = sparse[max(0, bisect.bisect_left(sparse, low, key=lambda x: x[0]) - 1)][1] if sparse else 0
    with open_path(path) as stream:
        stream.seek(start)
        held = b""
        while piece := stream.read(1 << 18):
            *whole, held = (held + piece).split(b"\n")
            for raw in whole:
                line = tuple(json.loads(raw))
                if high is not None and line[0] >= high:
                    return
                if low is None or line[0] >= low:
                    yield line


def merge_runs(paths: list[str], low: str | None, high: str | None, folder: str) -> Iterator[tuple]:
    """Lines of all runs with low <= key < high in order; more than FAN_IN runs are merged in turns, by way of runs of that range in folder."""
    while len(paths) > FAN_IN:
        longer = []
        for i in range(0, len(paths), FAN_IN):
            longer.append(f"{folder}/merged-{uuid.uuid4().hex}.run")
            write_run(LoserTree(read_run(p, low, high) for p in paths[i : i + FAN_IN]), longer[-1])
        paths = longer
    return iter(LoserTree(read_run(p, low, high) for p in paths))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, captured: str | None = None) -> list[dict]:
    """Writes a record for each row of pages (page_id, url, html) and returns archives and runs, a row each.

    Of rows whose payloads are equal and have at least min_bytes bytes, that with the smallest page_id is the response and the
    others revisit it; rows with smaller payloads are all responses. captured names a column of times of capture.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    id_ = F.col("page_id").cast("long")
    usual = F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(id_, F.lit(0)), F.lit(1 << 31)))
    when = F.coalesce(F.col(captured).cast("timestamp"), usual) if captured else usual
    rows = pages.select(id_.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")).withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    firsts = rows.where("page_id IS NOT NULL").groupBy("sha").agg(F.min(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n"))
    firsts = save(firsts.where("n > 1").select("sha", "first"), "warc-firsts")
    rows = rows.join(firsts, "sha", "left")
    again = (F.octet_length("html") >= min_bytes) & (F.col("page_id") > F.col("first.page_id"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "date", *(F.when(again, F.col(f"first.{c}")).cast("string").alias(f"refers_{c}") for c in ("page_id", "url", "date")))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out, name, at, lines, runs = None, "", 0, [], []

        def put() -> None:
            path = f"{folder}/{name}-{len(runs)}.run"
            lines.sort()
            n, cuts = write_run(lines, path)
            runs.append(("run", path, n, json.dumps(cuts)))
            lines.clear()

        for part in parts:
            for page_id, url, html, date, *refers in part[["page_id", "url", "html", "date", "refers_page_id", "refers_url", "refers_date"]].itertuples(index=False):
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = open_path(f"{folder}/{name}.warc.gz", "wb")
                payload = html.encode("utf-8", "surrogatepass")
                page_id = page_id if isinstance(page_id, str) else ""
                digest = payload_digest(payload)
                kind = "revisit" if isinstance(refers[0], str) else "response"
                data = record(kind, url, date, digest, payload, len(payload), page_id, tuple(refers), f"{name} {at}")
                out.write(data)
                lines.append((url_key(url), date, url, kind, digest, f"{name}.warc.gz", at, len(data), page_id))
                at += len(data)
                if len(lines) >= RUN_LINES:
                    put()
        if out is not None:
            out.close()
            put()
            yield pd.DataFrame([("warc", f"{folder}/{name}.warc.gz", 0, ""), *runs], columns=["kind", "path", "n", "cuts"])

    return [r.asDict() for r in rows.mapInPandas(write, "kind string, path string, n long, cuts string").collect()]


def merge_index(spark, made: list[dict], folder: str, shards: int | None = None) -> list[dict]:
    """Merges all runs into index shards in order of URL key and time; returns the shards: part, path, n, first, last.

    Ranges are cut at keys of the runs, CUTS of each. A capture history, all captures of a URL, stays in one shard: its lines are
    streamed, never held.
    """
    runs = [r["path"] for r in made if r["kind"] == "run"]
    if not runs:
        return []
    shards = shards or max(1, sum(r["n"] for r in made) // 100_000)
    keys = sorted(k for r in made if r["kind"] == "run" for k in json.loads(r["cuts"]))
    cuts = sorted({keys[len(keys) * i // shards] for i in range(1, shards)} - {keys[0]})
    ranges = [(i, low, high) for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    held = spark.sparkContext.broadcast(runs)  # a path for RUN_LINES pages

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, low, high in part[["part", "low", "high"]].itertuples(index=False):
                low, high = (x if isinstance(x, str) else None for x in (low, high))
                path, n, first, last = f"{folder}/index-{i:06d}-{uuid.uuid4().hex}.cdxj", 0, None, None
                with open_path(path, "wb") as out:
                    for line in merge_runs(held.value, low, high, folder):
                        key, date, url, kind, digest, name, at, size, page_id = line
                        facts = {"url": url, "type": kind, "digest": f"sha1:{digest}", "filename": name, "offset": at, "length": size, "page_id": page_id}
                        out.write(f"{key} {re.sub('[^0-9]', '', date)} {json.dumps(facts)}\n".encode("utf-8", "surrogatepass"))
                        n, first, last = n + 1, first if first is not None else key, key
                yield pd.DataFrame([(i, path, n, first, last)], columns=["part", "path", "n", "first", "last"])

    listed = spark.createDataFrame(spark.sparkContext.parallelize(ranges, len(ranges)), "part int, low string, high string")
    return sorted((r.asDict() for r in listed.mapInPandas(merge, "part int, path string, n long, first string, last string").collect()), key=lambda r: r["part"])


def records_of(index: str, folder: str) -> Iterator[list[tuple[dict, bytes]]]:
    """(facts of the index line, content of the record) of the lines of an index shard, in its order, READ_LINES at a time; an archive is read once a piece, front to back."""
    with open_path(index) as stream:
        held, ended = b"", False
        while not ended:
            lines: list[bytes] = []
            while len(lines) < READ_LINES and not ended:
                piece = stream.read(1 << 20)
                ended = not piece
                *whole, held = (held + piece).split(b"\n")
                lines += whole
            for i in range(0, len(lines), READ_LINES):
                facts = [json.loads(x[x.index(b" {") + 1 :]) for x in lines[i : i + READ_LINES]]
                found, archive = {}, None
                for j in sorted(range(len(facts)), key=lambda j: (facts[j]["filename"], facts[j]["offset"])):
                    if archive is None or archive[0] != facts[j]["filename"]:
                        if archive:
                            archive[1].close()
                        archive = facts[j]["filename"], open_path(f"{folder}/{facts[j]['filename']}")
                    archive[1].seek(facts[j]["offset"])
                    found[j] = gzip.decompress(archive[1].read(facts[j]["length"]))
                if archive:
                    archive[1].close()
                yield [(x, found[j]) for j, x in enumerate(facts)]


def read_archives(spark, index: list[dict], folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record that the merged index names, in its order."""
    kind = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    paths = [(r["path"],) for r in index]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                for piece in records_of(path, folder):
                    rows = []
                    for facts, content in piece:
                        fields, http, payload = parse(content)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if (fields["X-Page-Id"], f"sha1:{digest}") != (facts["page_id"], facts["digest"]):
                            raise ValueError(f"{path}: {facts['filename']} has another record at {facts['offset']}")
                        size = len(payload)
                        if fields["WARC-Type"] == "revisit":
                            size = int(re.search(rb"Content-Length: (\d+)", http)[1])  # that of the payload it stands for
                        elif payload_digest(payload) != digest:
                            raise ValueError(f"{path}: a payload doesn't have its digest")
                        rows.append((fields["X-Page-Id"] or None, facts["url"], size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page")))
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    if not paths:
        out = spark.createDataFrame([], kind)
    else:
        out = spark.createDataFrame(spark.sparkContext.parallelize(paths, len(paths)), "path string").mapInPandas(read, kind)
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, captured: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Writes pages to archives, merges their index, and reads the records back by it; returns read_archives() and the index shards.

    Null html and url count as empty; a null page_id gives a response that nothing refers to and that refers to nothing; rows that
    repeat a page_id with the same payload are responses both, with record ids of their own. Other columns are left alone, whatever
    their names; captured names one that holds times of capture. An empty table gives no archive.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    index = merge_index(spark, write_archives(pages, folder, min_bytes, captured), folder)
    return read_archives(spark, index, folder), index
