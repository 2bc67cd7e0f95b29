"""WARC archives: written, read back, and indexed by an external merge.

Payload digests are made in the JVM; equal payloads find the page that stays by the
tree merge of digest runs, so a payload that a third of all pages share is never
gathered in one task. Every record is a gzip member of its own, and an archive ends
when it holds ``archive_bytes``; a task writes below a folder of its attempt, and the
files appear once all tasks are done. An index entry's offset and length are those of
the member in the stored file, so one capture is read by one range (``fetch_captures``).

Reading back, members are inflated one after the other, and every archive yields one
locally sorted run of captures. Runs are dealt out by ranges of (URL key, timestamp,
page, place in the archives), so a URL that a third of all captures share is split.
Inside a range rows go back to the order that they have in their runs, by number, and
a loser tree merges the runs: one comparison per level for every capture taken. A run
stays as Arrow batches and hands out a few rows at a time, and there are as many
ranges as keep about ``RANGE_ROWS`` captures in one.

Defined results: a null html is the empty payload; payloads of under 100 bytes are
always responses. A null url has no target URI and the empty URL key; control
characters and blanks in a url are written percent-encoded. Without a timestamp
column a capture's time is 2024-01-01 plus page_id seconds. Of rows that repeat a
page_id and payload one is the response. A null page_id is larger than any other and
comes back as null. Pages of the same URL and time are in the order of page_id, rows
that repeat all three in that of the archives. A text longer than an archive is an
archive of its own. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from tidemark.llm._common import CLEAN_UP, pin, shared_dir, unpin
from tidemark.llm.exact_dedup import tree_merge
from tidemark.sources.staged import Attempt, Filled, Staged, opened

MIN_REVISIT = 100
#: Stored bytes after which an archive ends; an archive is read as one value.
ARCHIVE_BYTES = 64 << 20
#: Captures of a range that one task merges, about.
RANGE_ROWS = 500_000
#: Stored bytes inflated at once, and rows of a run handed to the tree at once.
PIECE, ROWS = 1 << 14, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def decide_revisits(pages: DataFrame, bits: int = 3, timestamp: str | None = None) -> DataFrame:
    """Pages with payload size, digest, record type and the page that a revisit refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    when = (
        F.col(timestamp).cast("timestamp_ntz")
        if timestamp
        else F.expr("timestampadd(SECOND, coalesce(pmod(page_id, 1000000000), 0), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    )
    runs = pin(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").alias("url"),
            html.alias("html"),
            F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2(html, 256)).alias("sha"),
            F.octet_length(html).cast("long").alias("n_bytes"),
        )
    )
    large = runs.filter(F.col("n_bytes") >= MIN_REVISIT).select("run", "sha", "n_bytes", "page_id", "row")
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    decided = tree_merge(large, ["sha", "n_bytes"], bits, first, F.min).drop("copies")
    out = runs.join(decided, ["run", "sha", "n_bytes"], "left").withColumn(
        "revisit", F.col("best").isNotNull() & (F.col("best.row") != F.col("row"))
    )
    out.pinned_at = runs.pinned_at
    return out


def record_text(decided: DataFrame) -> Column:
    """One WARC/1.1 record."""
    clean = F.col("url")
    for code in b"\t\n\r ":
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    clean = F.regexp_replace(clean, r"[\x00-\x1F\x7F]", "%00")
    dashed = lambda x: F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    uuid = lambda row: F.concat(F.lit("<urn:uuid:"), dashed(F.md5(F.concat(F.lit("page"), row.cast("string")))), F.lit(">"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    only = lambda value: F.when(F.col("revisit"), value)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(F.col("revisit"), F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        field("WARC-Record-ID", uuid(F.col("row"))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", clean),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("sha")))),
        field("WARC-Profile", only(F.lit(PROFILE))),
        field("WARC-Refers-To", only(uuid(F.col("best.row")))),
        field("Page-Id", F.col("page_id").cast("string")),
        field("Refers-To-Page-Id", only(F.col("best.page_id").cast("string"))),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
        F.lit(CRLF + CRLF),
    )


class Archives(DataSourceArrowWriter):
    """A task's records, each a gzip member, to files of about ``limit`` bytes."""

    def __init__(self, path: str, limit: int):
        self.target, self.limit, self.name = Staged(path, replace=False), limit, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Filled:
        mine, held, task = Attempt(self.target.staging), bytearray(), TaskContext.get().partitionId()
        for batch in batches:
            for record in batch.column(0):
                member = gzip.compress(record.as_buffer(), 6, mtime=0)
                if held and len(held) + len(member) > self.limit:
                    mine.put(f"{self.name}-{task:05d}-{mine.files:05d}.warc.gz", held)
                    held = bytearray()
                held += member
        if held:
            mine.put(f"{self.name}-{task:05d}-{mine.files:05d}.warc.gz", held)
        return mine.filled()

    def commit(self, messages: list) -> None:
        self.target.commit(messages)

    def abort(self, messages: list) -> None:
        self.target.abort()


class WarcFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> Archives:
        return Archives(self.options["path"], int(self.options["archiveBytes"]))


def write_archives(decided: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Adds the records to the archives below ``path``. Shuffle files of the write go when it is done."""
    spark = decided.sparkSession
    spark.dataSource.register(WarcFiles)
    records = decided.select(record_text(decided).cast("binary").alias("record"))
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        records.write.format("warc_files").option("archiveBytes", archive_bytes).mode("append").save(path)
    finally:
        spark.conf.set(CLEAN_UP, before)


def url_key(url: str) -> str:
    """Host labels from the top down, then the rest: ``com,example)/path``."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:] if url else ""


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of each gzip member of a stored archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, parts, to = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if to >= len(view):
                raise ValueError(f"the member at byte {at} is not closed")
            parts.append(inflate.decompress(view[to : to + PIECE]))
            to += PIECE
        end = min(to, len(view)) - len(inflate.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a member, by its stated length."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:head].decode("utf-8", "surrogateescape").split(CRLF)
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = head + 4
        end = start + int(fields["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not closed at byte {end}")
        yield fields, raw[start:end]
        at = end + 4


CAPTURE = (
    ("urlkey", pa.string(), "string"), ("date", pa.string(), "string"), ("page_id", pa.int64(), "long"),
    ("record_type", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"), ("archive", pa.string(), "string"), ("offset", pa.int64(), "long"),
    ("length", pa.int64(), "long"), ("place", pa.int64(), "long"),
)
SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in CAPTURE)


def order_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


def captures(archive: str, content: bytes) -> list[tuple]:
    """The sorted run of one archive. Digests of payloads that are there are made anew and held against the record's."""
    run = []
    for offset, length, raw in members(content):
        for fields, block in records(raw):
            http, _, payload = block.partition(b"\r\n\r\n")
            stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            n_bytes = int(http.rpartition(b"Content-Length: ")[2])
            if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != n_bytes):
                raise ValueError(f"{archive}: the payload at byte {offset} does not match its digest")
            page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
            run.append(
                (
                    url_key(fields.get("WARC-Target-URI", "")), fields["WARC-Date"], None if page is None else int(page),
                    fields["WARC-Type"], n_bytes, stated, None if refers is None else int(refers), archive, offset, length,
                )
            )
    return [(*row, place) for place, row in enumerate(sorted(run, key=order_key))]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(CAPTURE)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, (_, kind, _) in zip(columns, CAPTURE)], [n for n, _, _ in CAPTURE]
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives, each archive's own in order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield as_batch(captures(batch.column(0)[i].as_py().rpartition("/")[2], batch.column(1)[i].as_py()))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content").mapInArrow(parse, SCHEMA)


class LoserTree:
    """k-way merge of sorted runs, each read once: inner nodes hold the loser of their match, the root the winner."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.runs, self.key = [iter(run) for run in runs], key
        self.size = len(self.runs)
        self.rows = [None] * self.size
        self.heads = [self._head(i) for i in range(self.size)]
        self.losers = [-1] * max(1, self.size)
        for i in range(self.size):
            self._play(i, building=True)

    def _head(self, i: int):
        """The key of a run's next row; a run at its end loses to all."""
        for row in self.runs[i]:
            self.rows[i] = row
            return (0, self.key(row))
        return (1,)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.size and self.heads[self.losers[0]] != (1,):
            i = self.losers[0]
            yield self.rows[i]
            self.heads[i] = self._head(i)
            self._play(i)


def rows_of(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, ROWS).columns])


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, timestamp and page, over the whole result."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            ends = pc.run_end_encode(batch.column("archive"))
            at = 0
            for archive, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                pieces.setdefault(archive, []).append(batch.slice(at, end - at))
                at = end
        out = []
        for row in LoserTree(map(rows_of, pieces.values()), order_key):
            out.append(row)
            if len(out) == 10_000:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    runs = pin(runs)
    ranges = -(-runs.count() // RANGE_ROWS)
    usual = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["urlkey", "date", F.col("page_id").asc_nulls_last(), "archive", "offset"]
    dealt = runs.repartitionByRange(*([ranges] if ranges > usual else []), *keys)
    return dealt.sortWithinPartitions("archive", "place").mapInArrow(merge, SCHEMA).drop("place")


def fetch_captures(index: DataFrame, path: str) -> DataFrame:
    """(archive, offset, payload) of captures of the index, each read from its archive by its own range of bytes.

    A revisit has no payload of its own and gives none of its bytes: an empty one.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{root}/{archive}") as f:
                    f.seek(offset)
                    _, block = next(records(gzip.decompress(f.read(length))))
                payload = block.partition(b"\r\n\r\n")[2]
                yield pa.RecordBatch.from_pydict({"archive": [archive], "offset": [offset], "payload": [payload]})

    return index.select("archive", "offset", "length").mapInArrow(fetch, "archive string, offset long, payload binary")


def archive_pages(pages: DataFrame, path: str | None = None, timestamp: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as WARC, reads the archives back and returns their merged index."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    decided = decide_revisits(pages, timestamp=timestamp)
    write_archives(decided, path, archive_bytes)
    unpin(decided)
    return merge_index(read_runs(spark, path))
