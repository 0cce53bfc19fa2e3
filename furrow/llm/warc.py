"""WARC archives and their capture index.

Records are built in the JVM, compressed one gzip member each and gathered into archives of bounded
size; Spark's text sink writes each archive to a file of its own, so any store that Spark reaches holds
plain ``.warc.gz`` bytes and a capture's offset and length lead straight to its member. Reading inflates
member by member and gives, per archive, a run of captures sorted by URL key and timestamp. Runs are
cut by ranges of bounded size of that key and each range is merged by a loser tree over its runs, of
which each is read a slice at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large, materialize, shared_dir, table

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 1000
#: Compressed bytes at which an archive closes; a larger record stands alone. Captures in a range of the
#: merge; those of a run that are Python objects at a time. Parts that a digest's copies are dealt to.
ARCHIVE_BYTES, RANGE_CAPTURES, SLICE, SALTS = 16_000_000, 200_000, 256, 16
END = "\r\n\r\n"
#: An empty gzip member ends an archive, as its last byte, a zero, is the text sink's line separator.
LAST_MEMBER = zlib.compressobj(6, wbits=31).flush()
CAPTURE_SCHEMA = "run string, seq long, url_key string, timestamp string, url string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, offset long, length long"
CAPTURE_COLS = [x.split(" ")[0] for x in CAPTURE_SCHEMA.split(", ")]


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, k, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per row of pages, as the column ``value``.

    Of equal payloads of at least LEAST_BYTES, the one of the largest page_id is the response (each of
    them if rows repeat) and others are revisits of it; a null page_id is the smallest. A null html is
    an empty payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # Only keys move to find the winners; payloads that may have copies once, to meet them, a digest's in
    # several parts; small ones stay where they are.
    some, few = p.where(F.col("n") >= LEAST_BYTES), p.where(F.col("n") < LEAST_BYTES)
    first = some.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("digest", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    some = some.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    p = some.select("page_id", "url", "html", "n", "digest", "winner").union(few.select("page_id", "url", "html", "n", "digest", F.lit(None).cast("long")))
    revisit = F.coalesce((F.col("n") >= LEAST_BYTES) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK" + END)).otherwise(F.concat(http, F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.abs(F.coalesce("page_id", F.lit(0))) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    value = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        header("WARC-Target-URI", url),
        header("WARC-Date", date),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("winner"), F.col("digest")))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        header("X-Page-Id", F.col("page_id")),
        header("X-Refers-To-Page-Id", F.when(revisit, F.col("winner"))),
        header("X-Payload-Length", F.when(revisit, F.col("n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    return p.select(value.alias("value"))


def member(record: bytes) -> bytes:
    c = zlib.compressobj(6, wbits=31)
    return c.compress(record) + c.flush()


def _archives(size: int):
    def run(batches):
        large()
        out, n = [], 0
        for batch in batches:
            for record in batch.column(0):
                out.append(member(memoryview(record.as_buffer())))
                n += len(out[-1])
                if n >= size:
                    yield _archive(out)
                    out, n = [], 0
        if out:
            yield _archive(out)

    return run


def _archive(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join((*members, LAST_MEMBER[:-1]))], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, size: int = ARCHIVE_BYTES) -> None:
    """Write the records of pages to archives at path, one gzip member a record.

    A file closes at ``size`` compressed bytes. An empty table gives no archive.
    """
    value = records(pages).select((F.concat("value", F.lit(END))).cast("binary").alias("value"))
    archives = value.mapInArrow(_archives(size), "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case; ``www.`` and the scheme don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    at, view, step = 0, memoryview(raw), 1 << 14
    while at < len(raw):
        d, out, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(raw):
                raise ValueError(f"the member at byte {at} doesn't end")
            out.append(d.decompress(view[end : end + step]))
            end += len(view[end : end + step])
        end -= len(d.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """headers and block of a WARC record."""
    end = record.index(b"\r\n\r\n")
    version, *lines = record[:end].decode("utf-8", "surrogateescape").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    stop = end + 4 + int(head["Content-Length"])
    if record[stop:] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    return head, record[end + 4 : stop]


def read_record(raw: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """headers and block of the capture at a place of an archive, by its member alone."""
    return parse(zlib.decompress(raw[offset : offset + length], 31))


def captures(raw: bytes, name: str) -> list[tuple]:
    """The archive's captures, sorted by URL key, timestamp and page."""
    out = []
    for at, length, record in members(raw):
        if not record:
            continue
        head, block = parse(record)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response":
            payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
            n = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{name}: the payload at byte {at} doesn't have its digest")
        else:
            n = int(head["X-Payload-Length"])
        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        url, stamp = head.get("WARC-Target-URI"), "".join(c for c in head["WARC-Date"] if c.isdigit())
        out.append((url_key(url), stamp, url, page and int(page), head["WARC-Type"], digest, n, refers and int(refers), at, length))
    out.sort(key=capture_key)
    return [(name, k, *x) for k, x in enumerate(out)]


def capture_key(x: tuple) -> tuple:
    return x[0], x[1], x[3] is not None, x[3] or 0


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(CAPTURE_COLS)
    kinds = [pa.string() if kind == "string" else pa.int64() for kind in (x.split(" ")[1] for x in CAPTURE_SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=CAPTURE_COLS)


def _read(batches):
    large()
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield arrow(captures(raw.as_buffer().to_pybytes(), path.rsplit("/", 1)[-1]))


class LoserTree:
    """Merges sorted iterables: each inner node keeps the loser of its match, the root's winner is next."""

    def __init__(self, runs: Iterable[Iterable], key: Callable) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.head = [self.pulled(r) for r in range(len(self.runs))]
        k = len(self.runs)
        self.loser = [-1] * max(k, 1)
        for r in range(k):  # play each run up; the first to reach a node waits there
            at = (r + k) // 2
            while at and self.loser[at] >= 0:
                if self.beats(self.loser[at], r):
                    self.loser[at], r = r, self.loser[at]
                at //= 2
            self.loser[at] = r

    def pulled(self, r: int):
        item = next(self.runs[r], None)
        return None if item is None else (self.key(item), r, item)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self):
        k = len(self.runs)
        while k and self.head[self.loser[0]] is not None:
            r = self.loser[0]
            yield self.head[r][2]
            self.head[r] = self.pulled(r)
            at = (r + k) // 2
            while at:
                if self.beats(self.loser[at], r):
                    self.loser[at], r = r, self.loser[at]
                at //= 2
            self.loser[0] = r


def _sliced(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, a slice of Python objects at a time."""
    for part in parts:
        for a in range(0, part.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in part.slice(a, SLICE).columns), strict=True)


def _merge(batches):
    """Captures of one range in order, from rows sorted by run and place in it. The range stays in Arrow."""
    large()
    runs: list[list[pa.RecordBatch]] = []
    name = None
    for batch in batches:
        run = batch.column(0).dictionary_encode()
        codes, names = run.indices.to_numpy(), run.dictionary.to_pylist()
        edges = [0, *(codes[1:] != codes[:-1]).nonzero()[0] + 1, batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if names[codes[a]] != name:
                name = names[codes[a]]
                runs.append([])
            runs[-1].append(batch.slice(a, b - a))
    part, out, k = TaskContext.get().partitionId(), [], 0
    for row in LoserTree(map(_sliced, runs), lambda x: capture_key(x[2:])):
        out.append((row[0], (part << 40) + k, *row[2:]))
        k += 1
        if len(out) == 10_000:
            yield arrow(out)
            out = []
    yield arrow(out)


def capture_index(spark, path: str, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures of the archives at path: CAPTURE_SCHEMA, where ascending seq is the global order of
    URL key, timestamp and page. Nulls come first; equal captures stand in the order of their archives,
    by which ranges are cut too, so a URL that many captures share is no task's alone."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    runs = materialize(files.mapInArrow(_read, CAPTURE_SCHEMA))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_captures))
    ranges = runs.repartitionByRange(n, "url_key", "timestamp", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranges.mapInArrow(_merge, CAPTURE_SCHEMA)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS winner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM q
"""
