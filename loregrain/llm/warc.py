"""WARC archives, read index first.

``write`` puts a record for every page into compressed archives, a gzip member each, one archive a task, and returns the index:
file, offset, length, url, digest, page_id and type of every record. ``read`` takes any rows of an index, sorts them by file and
offset, joins neighbouring byte ranges into one read, and parses the records. An archive of a task that failed is in no
index, since the index is committed by Spark with the task that succeeded.

Of pages with equal payloads of at least ``least`` bytes, that with the largest page_id is a response record with the payload; the
others are revisit records, which name it and hold no payload. Equal means equal SHA-1 and length.

Defined results: null html is an empty payload, a null url an empty target. Rows that repeat the largest page_id of their payload
are all responses. A row with a null page_id revisits, if any row with the same payload has a page_id. Empty tables give empty
results. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, shared_dir, staged

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
GAP = 64 << 10
READ = 8 << 20
#: Archive bytes of a read task: at least, so that few records make few tasks, and at most.
TASK = (1 << 20, 128 << 20)
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool) -> bytes:
    """A record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if is_response else http
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not is_response:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(field: str | None) -> int | None:
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _hex(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def classified(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), record_type and refers_to of every page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    light = pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
    best = light.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").drop("n")
    # pages with a twin are told by page_id, and only those travel with their payload's key
    revisits = light.join(best, ["sha", "size"]).where("not (page_id <=> best)").select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "best").distinct()
    own = pages.select("page_id", "url", payload.alias("payload"))
    joined = own.join(revisits, own["page_id"].eqNullSafe(revisits["__id"]) & (F.sha1("payload") == F.col("__sha")), "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("__sha").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("best").alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Writes the archives to a folder that all executors reach, by default in the shared one; returns the index, itself written."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        files, path = _file_system(folder)
        out, name, at = None, "", 0
        try:
            for rows in rows_of(batches, "page_id", "url", "payload", "record_type", "refers_to"):
                if out is None:
                    files.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                index = []
                for page_id, url, payload, kind, refers_to in rows:
                    data = gzip.compress(record(page_id, url, payload, refers_to, kind == "response"), 6, mtime=0)
                    out.write(data)
                    index.append((f"{folder}/{name}", at, len(data), url, hashlib.sha1(payload).hexdigest(), page_id, kind))
                    at += len(data)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return staged(classified(pages, least).mapInArrow(run, INDEX), "warc-index")


RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def _records(ranges):
    """(bytes of a member) for (file, offset, length) sorted by file and offset, in joined reads."""
    source, opened, files = None, None, None
    held: list[tuple[int, int]] = []

    def flush():
        if not held:
            return
        start = held[0][0]
        source.seek(start)
        data = source.read(max(o + n for o, n in held) - start)
        for o, n in held:
            yield data[o - start : o - start + n]
        held.clear()

    for file, offset, length in ranges:
        if file != opened:
            yield from flush()
            if source:
                source.close()
            files, path = _file_system(file)
            source, opened = files.open_input_file(path), file
        if held and (offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ):
            yield from flush()
        held.append((offset, length))
    yield from flush()
    if source:
        source.close()


def read(index: DataFrame) -> DataFrame:
    """The records of the index's rows: page_id, url, record_type, refers_to, digest (of the full payload) and the payload that the record holds."""

    def run(batches):
        def ranges():
            for rows in rows_of(batches, "file", "offset", "length"):
                yield from rows

        out, size = [], 0

        def batch():
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

        for data in _records(ranges()):
            fields, payload = parse(gzip.GzipFile(fileobj=io.BytesIO(data)).read())
            out.append((_page(fields["WARC-Record-ID"]), unquote(fields["WARC-Target-URI"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), _hex(fields["WARC-Payload-Digest"]), payload))
            size += len(payload)
            if len(out) >= 256 or size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    chosen = index.select("file", "offset", "length")
    size = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(min(size // TASK[0], 2 * index.sparkSession.sparkContext.defaultParallelism), size // TASK[1]) + 1
    return chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def warc_digest(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from archives."""
    found = read(write(pages, least=least))
    found = staged(found.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to"), "warc-read")
    whole = found.where("record_type = 'response'")
    key = ["refers_to", "payload_digest"]
    named = whole.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    again = found.where("record_type = 'revisit'").drop("payload_bytes").join(named, key, "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(names).unionByName(again.select(names))
