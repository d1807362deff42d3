"""WARC archives, index first.

Each task writes one archive of gzip members and yields a row with offset,
length, URL and digest for each record; those rows are the index.  Reading takes
index rows, sorts them by archive and offset, and joins neighbouring byte ranges
into one read.  A retried task writes an archive of a new name, so that only
what the index lists counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import checkpointed, scratch_dir, written

#: Ranges closer than GAP are read at once, up to SPAN bytes; bytes that a task reads, about.
GAP, SPAN, TASK = 256 << 10, 8 << 20, 4 << 20
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed; digest is the payload's SHA-1 in base32."""
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page, digest), "WARC-Date": "2000-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers_to, digest)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    if page is not None:
        head["X-Page"] = str(page)
    if revisit and refers_to is not None:
        head["X-Refers-To-Page"] = str(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page, url, payload, payload bytes, digest, type, refers_to) of a record; its digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length does not fit its content")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    if fields["WARC-Type"] == "revisit":
        return int(page) if page else None, fields.get("WARC-Target-URI"), None, size, digest, "revisit", int(refers) if refers else None
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of page {page} does not fit its digest")
    return int(page) if page else None, fields.get("WARC-Target-URI"), payload, len(payload), digest, "response", None


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, *, page: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write a record for each page to archives in `folder`; returns their index.

    Of pages with equal payloads of at least `revisit_from` bytes, the smallest
    page id is a response and the others revisit it.  A null text is an
    empty payload; a null id comes after all others; rows that share id and
    payload are alike, so both are responses or both revisits.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    light = rows.where(F.octet_length("payload") >= revisit_from).select("page_id", "sha1")
    groups = light.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    groups = checkpointed(groups.select("sha1", "first_id"))
    later = light.join(groups, "sha1").where("page_id is null or page_id <> first_id").distinct()
    later = later.select(F.col("page_id").alias("later_id"), F.col("sha1").alias("later_sha1"), "first_id")
    later = written(later, "revisits")  # its size then decides whether payloads are moved to it or it to them
    marked = rows.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("sha1") == F.col("later_sha1")), "left")
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    ident, link, body, sha1, later, first = (batch.column(k)[i].as_py() for k in range(6))
                    digest = base64.b32encode(sha1).decode()
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(ident, link, body, digest, first, later)) + squeeze.flush()
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    found.append((f"{folder}/{name}", at, len(member), link, digest, "revisit" if later else "response", ident))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_INDEX_TYPES)], [c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out:
                out.close()

    ready = marked.select("page_id", "url", "payload", "sha1", F.col("later_sha1").isNotNull().alias("later"), "first_id")
    return written(ready.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(archive, offset, length, first, last) of reads that cover sorted rows; neighbours are joined."""
    out: list[list] = []
    for i, (archive, offset, length) in enumerate(rows):
        if out and out[-1][0] == archive and offset - (out[-1][1] + out[-1][2]) <= GAP and offset + length - out[-1][1] <= SPAN:
            out[-1][2], out[-1][4] = max(out[-1][2], offset + length - out[-1][1]), i + 1
        else:
            out.append([archive, offset, length, i, i + 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, *, payload: bool = True) -> DataFrame:
    """The records of index rows, each checked against its digest; payload=False leaves out the bytes.

    A record that the archive does not hold as indexed is an error.  An empty
    index gives no rows; repeated index rows give repeated records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for archive, offset, length, first, last in ranges(rows):
                if archive not in files:
                    for f in files.values():
                        f.close()
                    fs, path = _filesystem(archive)
                    files = {archive: fs.open_input_file(path)}
                data = files[archive].read_at(length, offset)
                found = []
                for _, at, size in rows[first:last]:
                    raw = zlib.decompress(data[at - offset : at - offset + size], 31)
                    x = parse_record(raw)
                    found.append(x if payload else (*x[:2], None, *x[3:]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_RECORD_TYPES)], [c.split()[0] for c in RECORDS.split(", ")])
        for f in files.values():
            f.close()

    size = index.agg(F.sum("length")).first()[0] or 0
    ordered = index.select("archive", "offset", "length").repartitionByRange(int(size // TASK) + 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, RECORDS)


def archive_folder(df: DataFrame) -> str:
    """A new folder for archives that last as long as the application, in the folder that driver and executors share."""
    return f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}-warc"
