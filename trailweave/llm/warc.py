"""WARC archives of pages, and a globally ordered index of their captures.

Records are written by Spark's own text writer, which ends each with the two CRLF that close a
WARC record, so any file system that Spark writes can hold the archives and its commit protocol
drops what a lost executor left behind.  Archives are cut by bytes and read as streams.  Each
archive gives a capture run sorted by URL key and timestamp.  The index is an external merge: runs
meet in ranges of these keys, a task keeps its share of each run in the order in which it comes,
beyond a bound of memory in files of its own, and a loser tree merges the runs batch by batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.session import checkpoint, ensure_checkpoint_dir, join_checked

#: RFC 4648 alphabet (fixed value).
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Capture time of page 0; further pages follow by a second each where no time column is given.
FIRST_CAPTURE = 1_704_067_200
_END = "\r\n\r\n"
CAPTURES = (
    "archive string, page_id long, url string, url_key string, captured string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean, offset long, length long"
)
#: Bytes of records after which the next archive begins; a longer record is an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes that are unzipped at a time, runs that are merged at once, and bytes of runs that a task holds in memory.
_PIECE, FAN_IN, HELD_BYTES = 1 << 16, 64, 64 << 20
#: Rows of a run in a batch, of which the merge holds one a run.
_ROWS = 2000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8: 4 groups of 40 bits, 8 letters each."""
    digits = F.sha1(payload.cast("binary"))
    # hexadecimal digits are numbers in base 16, and base 32 has the digits 0-9 and A-V
    groups = [F.lpad(F.conv(F.substring(digits, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to.

    Of the records with equal payloads of ``least_bytes`` or more, that with the smallest id is
    the response (all of them, should the row be repeated) and the others revisit it.  A row
    without an id is a response unless a row with an id has its payload.
    """
    digested = pages.withColumn("payload_digest", base32_sha1(F.col("html")))
    counted = digested.where(F.octet_length("html") >= least_bytes).groupBy("payload_digest")
    firsts = counted.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = join_checked(digested, firsts, "payload_digest")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    return joined.select(
        "page_id", "url", "html", "captured", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def records(typed: DataFrame) -> DataFrame:
    """One column ``value``: each row's WARC record without its closing blank lines."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    record_id = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END)
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return typed.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", record_id(F.col("page_id"))),
            line("WARC-Date", F.col("captured")),
            line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " ")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            line("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
            line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def _numbered(archive_bytes: int):
    """Adds to each record the number of its archive within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(sizes)
            yield batch.append_column("archive", pa.array((ends - sizes) // archive_bytes))
            before = int(ends[-1]) if len(ends) else before

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the pages (page_id, url, html, captured) as gzipped WARC files of about ``archive_bytes`` under ``folder``.

    Archives are numbered within a partition, so rows come in order and no file grows with the input.
    """
    numbered = records(with_types(pages, least_bytes)).mapInArrow(_numbered(archive_bytes), "value string, archive long")
    numbered.write.option("lineSep", _END).option("compression", "gzip").partitionBy("archive").text(folder)


def url_key(url: str | None) -> str:
    """Sortable key of an address: reversed host, then path and query; '' if there is none."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{query}" if query else "")


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def unzipped(content: bytes | memoryview) -> Iterator[bytes]:
    """What a gzip file holds, also one of several members, some ten KB at a time."""
    stream = zlib.decompressobj(31)
    for at in range(0, len(content), _PIECE):
        part = bytes(content[at : at + _PIECE])
        while part:
            yield stream.decompress(part, 16 * _PIECE)
            part = stream.unconsumed_tail
            if stream.eof:
                part, stream = stream.unused_data, zlib.decompressobj(31)


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes, int, int]]:
    """(header fields, block, offset, length) of each record, by the lengths that the headers tell.

    Of the archive no more than a record and a piece is held.  A record that breaks off has the
    block that is there.
    """
    held, gone, more = bytearray(), 0, True

    def need(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            piece = next(pieces, None)
            more = piece is not None
            held.extend(piece or b"")
        return len(held) >= n

    def find(what: bytes) -> int:
        start = 0
        while (at := held.find(what, start)) < 0:
            start = max(0, len(held) - len(what))
            if not need(len(held) + 1):
                return -1
        return at

    while (at := find(b"WARC/")) >= 0:
        del held[:at]
        gone += at
        if (head := find(b"\r\n\r\n")) < 0:
            return
        fields = {k.lower(): v for k, v in _FIELD.findall(bytes(held[:head]))}
        length = head + 4 + int(fields[b"content-length"])
        need(length)
        yield fields, bytes(held[head + 4 : length]), gone, length
        del held[: length + 4]
        gone += length + 4


def _number(field: bytes | None) -> int | None:
    digits = (field or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


_SCHEMA = pa.schema(
    [("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("record_type", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())]
)


def capture(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """(page_id, url, url_key, captured, record_type, payload_bytes, payload_digest, refers_to, intact) of a record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    size = int(dict((k.lower(), v) for k, v in _FIELD.findall(head)).get(b"content-length", b"-1"))
    whole = len(block) == int(fields[b"content-length"])
    intact = whole and (kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest))
    url = fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None
    return _number(fields[b"warc-record-id"]), url, url_key(url), fields[b"warc-date"].decode(), kind, size, digest, _number(fields.get(b"warc-refers-to")), intact


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, sorted by URL key, timestamp and page."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = [(path, *capture(fields, block), at, n) for fields, block, at, n in parsed(unzipped(memoryview(content.as_buffer())))]
            rows.sort(key=_order)
            columns = zip(*rows) if rows else [[]] * len(_SCHEMA)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _order(row: tuple) -> tuple:
    return row[3], row[4], -1 if row[1] is None else row[1]


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under ``folder``, as read from the files; each archive is a sorted run.

    ``intact`` tells whether a record is whole and a response's bytes have the length and digest
    that its headers tell; ``offset`` and ``length`` where it is in the unzipped archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(_runs, CAPTURES)


class LoserTree:
    """Merges sorted iterators of (key, value): a match with the losers on the way up per item.

    An exhausted run plays as ``None``, which loses to every item; ties go to the lower run.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(x, None) for x in runs] or [None]
        self.losers = [-1] * self.k
        for run in range(self.k - 1, -1, -1):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _replay(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # while the tree is built: wait here for the other one
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.heads[winner := self.losers[0]]) is not None:
            yield item
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


class SortedRuns:
    """Sorted runs of rows that come one after the other, kept in memory up to a bound and then in files of the task.

    The files are the task's own scratch space, like the files of a sort; they go when it ends.
    """

    def __init__(self, schema: pa.Schema, held_bytes: int, folder: str):
        self.schema, self.most, self.folder = schema, held_bytes, folder
        self.runs: list[list[pa.RecordBatch] | str] = []
        self.size = 0

    def begin(self) -> None:
        self.runs.append([])

    def add(self, batch: pa.RecordBatch) -> None:
        self.runs[-1].append(batch)
        self.size += batch.nbytes
        if self.size > self.most:
            self.runs = [self._stored(x) if isinstance(x, list) else x for x in self.runs]
            last = self.runs[-1]
            self.runs[-1:] = [last, []]  # the open run goes on as a run that continues the stored one
            self.size = 0

    def _stored(self, batches: Iterable[pa.RecordBatch]) -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, self.schema) as writer:
            for batch in batches:
                writer.write_batch(batch)
        return path

    def _read(self, run: list[pa.RecordBatch] | str) -> Iterator[pa.RecordBatch]:
        if isinstance(run, list):
            yield from run
            return
        with pa.OSFile(run, "rb") as source, pa.ipc.open_stream(source) as reader:
            yield from reader

    def merged(self) -> Iterator[pa.RecordBatch]:
        """All rows in order, ``FAN_IN`` runs at a time."""
        while len(self.runs) > FAN_IN:
            groups = [self.runs[k : k + FAN_IN] for k in range(0, len(self.runs), FAN_IN)]
            self.runs = [self._stored(_woven([self._read(x) for x in g], self.schema)) for g in groups]
        yield from _woven([self._read(x) for x in self.runs], self.schema)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple[pa.RecordBatch, int]]]:
    """(sort key, (batch, row)) of each row."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            keys = zip(*(part.column(c).to_pylist() for c in ("url_key", "captured", "page_id")))
            for i, (key, when, page) in enumerate(keys):
                yield (key, when, -1 if page is None else page), (part, i)


def _woven(runs: list[Iterator[pa.RecordBatch]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of sorted runs in one order, through a loser tree; of each run a batch is held, and a batch of results."""
    parts: dict[int, pa.RecordBatch] = {}
    starts: dict[int, int] = {}
    wanted: list[int] = []
    total = 0
    for _, (part, i) in LoserTree([_keyed(x) for x in runs]):
        if id(part) not in parts:
            parts[id(part)], starts[id(part)] = part, total
            total += len(part)
        wanted.append(starts[id(part)] + i)
        if len(wanted) >= _ROWS:
            yield pa.Table.from_batches(list(parts.values()), schema).take(wanted).combine_chunks().to_batches()[0]
            parts, starts, wanted, total = {}, {}, [], 0
    if wanted:
        yield pa.Table.from_batches(list(parts.values()), schema).take(wanted).combine_chunks().to_batches()[0]


def _merged(held_bytes: int):
    """The rows of a range, which come run by run, merged in order and numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        with tempfile.TemporaryDirectory() as folder:
            runs, last = None, None
            for batch in batches:
                runs = runs or SortedRuns(batch.schema, held_bytes, folder)
                archives = batch.column("archive").dictionary_encode()
                cuts = [0, *(np.flatnonzero(np.diff(archives.indices.to_numpy())) + 1).tolist(), len(batch)]
                for low, high in zip(cuts, cuts[1:]):
                    if low < high:
                        archive = batch.column("archive")[low].as_py()
                        if archive != last:
                            runs.begin()
                            last = archive
                        runs.add(batch.slice(low, high - low))
            for batch in runs.merged() if runs else ():
                yield batch.append_column("index_order", pa.array(np.arange(number, number + len(batch))))
                number += len(batch)

    return run


def capture_index(found: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``found`` in one order by URL key, timestamp and page over all partitions, with ``index_order``.

    Ranges are cut by all three keys, so that the captures of a frequent URL spread over several;
    within a range each archive's captures come as a sorted run.
    """
    ranged = found.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("archive", "url_key", "captured", "page_id")
    return ranged.mapInArrow(_merged(held_bytes), f"{CAPTURES}, index_order long")


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Pages written as WARC records, read back, and indexed: one row per record.

    Columns: those of ``CAPTURES`` and index_order.  A null html is the empty payload.  A null
    URL has no target field and the empty key.  Null ids are kept as null and sort first.
    Repeated rows are written as often as they occur.  An empty table gives an empty index.
    The archives lie in a folder of their own under the shared checkpoint folder.  A record that
    doesn't read back as it was written is an error.
    """
    spark = pages.sparkSession
    when = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10**9)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(rows, folder, least_bytes, archive_bytes)
    return capture_index(checked(checkpoint(captures(spark, folder))))


def checked(found: DataFrame) -> DataFrame:
    """``found``, an error if a record isn't intact."""
    damaged = F.concat(F.lit("damaged record in "), F.col("archive"), F.lit(" at "), F.col("offset").cast("string"))
    return found.withColumn("intact", F.when(F.col("intact"), True).otherwise(F.raise_error(damaged).cast("boolean")))
