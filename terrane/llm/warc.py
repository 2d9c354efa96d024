"""WARC archives: segmented records with chunked bodies are written, read back and put together again.

Writing: each page becomes a response record (an HTTP head and the payload in chunked framing) or, where its payload
equals that of a page with a larger id, a revisit record that keeps the head and names that page. A block longer than
the segment size is cut into a first record and continuation records, which go to files of their own. Archives are gzip
members, one a record, in files of bounded size in the shared folder; a task's files count only if the task ended, since
only then its manifest rows do.

Reading: each file is parsed once. Records in one piece are decoded where they are read; segments are dealt out by the
origin's record id and sorted by segment number, and pass through as a stream: one record's segments are held at a
time, checked against the total length, joined, and their chunks decoded.

Defined results: a null html is an empty payload; a null page_id is kept, is never the largest and is not referred to;
rows that share page_id and payload with the response are responses too. A record whose segments are missing, repeated
or of another total length, or whose framing is broken, has intact = false and a null payload. Segments of one origin
that lost their first record give a row with a null page_id. No pages, no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, cut, small_batches

#: Bytes of a block that is not cut, of a chunk of a body, and of a finished archive file before compression.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 16_384, 4_096, 64 << 20
#: Payloads from this size on are replaced by revisits.
REVISIT_BYTES = 0
DATE, VERSION = "2024-01-01T00:00:00Z", b"WARC/1.1\r\n"
_MANIFEST = "path string, n_records long, n_bytes long, n_segments long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"
_SEGMENT = "origin string, page_id long, url string, digest string, segment int, total long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts) if body[at : at + 2] == b"\r\n" else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"%b%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (VERSION, head.encode(), len(block), block)


def page_records(serial: str, page_id: int | None, url: str | None, payload: bytes, response: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; response: the page to which a revisit refers."""
    name = f"<urn:terrane:page:{'' if page_id is None else page_id}:{serial}>"
    # a uri can't hold line ends: the reader gets it back as it was
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else url.encode("unicode_escape").decode()), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    if response is not None:
        block = b"%bContent-Length: %d\r\n\r\n" % (head, len(payload))
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:terrane:page:{response}>")], block)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part
        )


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder; returns path, n_records and n_bytes of each file.

    Equal payloads meet by their SHA-1 in a count with partial sums; the join back is one that can split large keys.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    slim = pages.where(F.octet_length("payload") >= revisit_bytes)
    first = slim.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "response")
    rows = pages.join(first, "sha1", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, done = TaskContext.get().partitionId(), 0, []
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        open_files: dict[bool, list] = {}  # by whether it holds segments: path, stream, records, bytes

        def close(cut_up: bool) -> None:
            path, out, n, size = open_files.pop(cut_up)
            out.close()
            done.append((path, n, size, n if cut_up else 0))

        for batch in batches:
            for page_id, url, body, response in zip(*(batch.column(i) for i in range(4)), strict=True):
                serial += 1
                records = list(page_records(f"{task}.{serial}", page_id.as_py(), url.as_py(), body.as_py(), response.as_py(), segment_bytes))
                cut_up = len(records) > 1
                if cut_up not in open_files:
                    name = f"{'segments' if cut_up else 'part'}-{task:06d}-{uuid.uuid4().hex}.warc.gz"
                    open_files[cut_up] = [f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None), 0, 0]
                own = open_files[cut_up]
                for record in records:
                    own[1].write(_member(record))
                    own[2], own[3] = own[2] + 1, own[3] + len(record)
                if own[3] >= file_bytes:
                    close(cut_up)
        for cut_up in list(open_files):
            close(cut_up)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes", "n_segments"])

    return cut(small_batches(rows).mapInArrow(write, _MANIFEST))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        yield fields, block


def _int(text: str | None) -> int | None:
    return int(text) if text else None


def _url(fields: dict[str, str]) -> str | None:
    return fields["warc-target-uri"].encode().decode("unicode_escape") if "warc-target-uri" in fields else None


def response_row(page_id: int | None, url: str | None, digest: str, block: bytes | None) -> tuple:
    """A row of _RECORD from a whole block."""
    head, gap, body = (block or b"").partition(b"\r\n\r\n")
    payload = (unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body) if gap else None
    found = None if payload is None else digest_of(payload)
    if found is None or digest.removeprefix("sha1:") != found:
        return page_id, url, "response", None, None, None, None, False
    return page_id, url, "response", None, payload, len(payload), found, True


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
_SEGMENT_ARROW = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _read(segments: bool):
    """A task that reads files: whole records, or the segments of cut ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SEGMENT_ARROW if segments else _RECORD_ARROW
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for x, block in parse(io.BufferedReader(stream, 1 << 20)):
                        part = "warc-segment-number" in x
                        if part != segments or x["warc-type"] not in ("response", "revisit", "continuation"):
                            continue
                        if part:
                            rows.append((x.get("warc-segment-origin-id", x["warc-record-id"]), _int(x.get("x-page-id")), _url(x), x.get("warc-payload-digest"), int(x["warc-segment-number"]), _int(x.get("warc-segment-total-length")), block))
                        elif x["warc-type"] == "revisit":
                            length = next((int(v) for k, _, v in (h.partition(b":") for h in block.split(b"\r\n")) if k.lower() == b"content-length"), None)
                            rows.append((_int(x.get("x-page-id")), _url(x), "revisit", int(x["warc-refers-to"][1:-1].split(":")[3]), None, length, x["warc-payload-digest"].removeprefix("sha1:"), True))
                        else:
                            rows.append(response_row(_int(x.get("x-page-id")), _url(x), x["warc-payload-digest"], block))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield _batches(rows, schema)
                            rows, size = [], 0
        if rows:
            yield _batches(rows, schema)

    return read


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from segments in order of origin and number; a record's segments may lie in several batches."""
    rows, size = [], 0
    origin, head, blocks, whole, last = None, None, [], True, None

    def ended() -> tuple:
        block = b"".join(blocks)
        return response_row(*head, block if whole and last == len(block) else None)

    for batch in batches:
        for x in batch.to_pylist():
            if x["origin"] != origin:
                if origin is not None:
                    rows.append(ended())
                    size += sum(map(len, blocks))
                origin, head, blocks, whole, last = x["origin"], (None, None, ""), [], True, None
            if x["segment"] == 1 and not blocks:
                head = (x["page_id"], x["url"], x["digest"] or "")
            # the total length stands in the last segment; nothing comes after it
            whole = whole and x["segment"] == len(blocks) + 1 and last is None
            if whole:
                blocks.append(x["block"])
                last = x["total"]
            else:
                blocks = blocks[:1]
            if size > 4 << 20:
                yield _batches(rows, _RECORD_ARROW)
                rows, size = [], 0
    if origin is not None:
        rows.append(ended())
    if rows:
        yield _batches(rows, _RECORD_ARROW)


def read_archives(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """The pages of the archives listed by path: page_id, url, record_type, refers_to, payload, its length and digest, intact.

    manifest: path and, if known, n_records and n_segments (records that are parts of one); a file of which they say
    that it has records of one kind only is read once. Only segments are shuffled, by the origin's record id. A revisit
    has no payload; its length and digest are those of the page it refers to.
    """
    tasks = tasks or max(2, 2 * manifest.sparkSession.sparkContext.defaultParallelism)
    known = {"n_records", "n_segments"} <= set(manifest.columns)
    one, cut_up = (manifest.where("n_records > n_segments"), manifest.where("n_segments > 0")) if known else (manifest, manifest)
    whole = one.select("path").repartition(tasks).mapInArrow(_read(False), _RECORD)
    parts = cut_up.select("path").repartition(tasks).mapInArrow(_read(True), _SEGMENT)
    return whole.unionByName(small_batches(parts.repartition("origin").sortWithinPartitions("origin", "segment")).mapInArrow(_join_segments, _RECORD))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages to archives in folder, or in one of the shared folder that goes with the application, and read them back."""
    return read_archives(write_archives(pages, folder or Scratch(pages.sparkSession, "warc").at, **options))
