"""WARC archives: written by tasks, and read back in byte ranges with boundary-chain verification.

Writing: each task writes files of its own to a shared folder and returns them for the manifest, the only list that
is read; files of lost or repeated attempts stay unlisted.  Of records with equal payloads the one with the largest
page id is a response, the others revisit it.

Reading: a task scans a byte range of a file for the record magic and emits, for each hit, its offset and the offset
where the record that would start there ends; a header of any length is read to its end.  Pointer jumping from offset 0 of each file (the reach doubles every
round) keeps the hits that are reachable; magic inside payloads is not, and is dropped.  A file with another number of reachable records than its manifest says is an error.

Defined results: a null html is an empty payload, and equal to other empty ones; each row has one record, also where a
page id comes with several payloads, each of which is a response or a revisit by itself; of equal page ids with equal
payloads all are responses; a null page id is written as "null" and ranks below all others; an empty table gives an empty archive; columns other than id and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tracelake.llm.links import small
from tracelake.sources.shared import cut, drop, shared_dir

MAGIC, FIELD = b"WARC/1.1\r\n", b"\r\nContent-Length: "
#: A file is closed when it is this large; a task reads ranges of this many bytes.
FILE_BYTES, RANGE_BYTES = 128 << 20, 4 << 20
#: Bytes read past a range for headers that begin in it, and at a time for longer ones; no limit to a header.
READ_ON = 1 << 16
#: Payloads of at least so many bytes are deduplicated.
LEAST_BYTES = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        MAGIC.decode().strip(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2025-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', '', url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at `at` and where its block begins; None if it isn't one."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    return (fields, end + 4) if fields.get("Content-Length", "").isdigit() else None


def _ends(f: pa.NativeFile, begin: int, stop: int, length: int) -> Iterator[tuple[int, int]]:
    """(at, next) of the magic places in `length` bytes from begin.  Places before the same blank line share the search for it and for the
    last Content-Length, and data grows until that line is found."""
    f.seek(begin)
    data = bytearray(f.read(min(stop - begin, length + READ_ON + len(MAGIC))))
    end, field = -1, -1
    at = data.find(MAGIC)
    while 0 <= at < length:
        if end < at:
            end = data.find(b"\r\n\r\n", at)
            while end < 0:
                seen = len(data)
                more = f.read(min(stop - begin - seen, max(READ_ON, seen)))
                if not more:
                    return
                data += more
                end = data.find(b"\r\n\r\n", max(at, seen - 3))
            field = data.rfind(FIELD, at, end)
        if field >= at and (n := bytes(data[field + len(FIELD) : end]).split(b"\r\n", 1)[0]).isdigit() and len(n) < 18:
            yield begin + at, begin + end + 4 + int(n) + 4
        at = data.find(MAGIC, at + 1)


def _marked(pages: DataFrame, id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): only revisits get a refers_to; texts are moved only if revisits are many.  A revisit
    is told by its page id and its payload's digest, as one page id may come with several payloads."""
    body = F.coalesce(F.col(html), F.lit("")).alias("html")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body).withColumn("digest", F.unhex(F.sha1("html")))
    sums = cut(rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"))
    last = cut(sums.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    below = F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull())
    again = cut(sums.join(last, "digest").where(below).select(F.col("page_id").alias("again"), F.col("digest").alias("payload"), "refers_to").distinct())
    drop(sums, last)  # again is written
    same = rows.page_id.eqNullSafe(F.col("again")) & (rows.digest == F.col("payload"))
    return rows.join(small(again), same, "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archive and returns its manifest (file, bytes, records)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        files, out, size, n = [], None, 0, 0

        def close():
            nonlocal out, size, n
            if out is not None:
                out.close()
                files.append((name, size, n))
            out, size, n = None, 0, 0

        for batch in batches:
            for page, address, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out = store.open_output_stream(f"{root}/{name}")
                made = record("null" if page is None else str(page), address, body.encode(), None if refers is None else str(refers))
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], ["file", "bytes", "records"])

    return cut(_marked(pages, id, url, html, least_bytes).mapInArrow(of, "file string, bytes long, records long"))


def _ranges(manifest: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("begin")
    ranges = manifest.where("bytes > 0").select("file", "bytes", at)
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return ranges.repartition(n, "file", "begin")


def candidates(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, at, next): each place where the magic stands and a header parses, and where that record would end."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for name, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    out += [(name, at, end) for at, end in _ends(f, begin, size, RANGE_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["file", "at", "next"])

    return _ranges(manifest).select("file", "bytes", "begin").mapInArrow(of, "file string, at long, next long")


def reachable(found: DataFrame) -> DataFrame:
    """The rows of (file, at, next) on the chain from offset 0 of their file, by pointer jumping."""
    found = cut(found)
    jump = cut(found.select("file", "at", F.col("next").alias("to")).join(found.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi").select("file", "at", "to"))
    reach = cut(found.where("at = 0").select("file", "at"))
    while True:
        ahead = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = cut(reach.unionByName(ahead))
        jump = cut(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")))
        if jump.isEmpty():
            return found.join(reach, ["file", "at"], "left_semi")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload, intact) of each record; a revisit has no payload of
    its own, intact tells whether the payload has the digest of its header."""
    kept = cut(reachable(candidates(manifest, folder)))
    whole = manifest.join(kept.groupBy("file").agg(F.count("*").alias("reached")), "file", "left").select("file", "records", F.coalesce("reached", F.lit(0)).alias("reached"))
    if bad := whole.where("reached <> records").first():
        raise ValueError(f"{bad.file}: {bad.reached} of {bad.records} records can be reached")
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = kept.withColumn("range", F.floor(F.col("at") / RANGE_BYTES)).repartition(n, "file", "range").sortWithinPartitions("file", "at").select("file", "at", "next")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, f = None, None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact")}
            for file, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, f = file, store.open_input_file(f"{root}/{file}")
                f.seek(at)
                data = f.read(end - at)
                fields, begin = header(data, 0)
                body = data[begin : begin + int(fields["Content-Length"])]
                http, _, payload = body.partition(b"\r\n\r\n")
                page = lambda x: None if (p := fields[x][len("<urn:page:") : -1]) == "null" else int(p)  # noqa: E731, B023
                whole = fields["WARC-Type"] == "response"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                out["page_id"].append(page("WARC-Record-ID"))
                out["payload_bytes"].append(len(payload) if whole else int(re.search(rb"Content-Length: (\d+)", http)[1]))
                out["payload_digest"].append(base32_sha1(payload) if whole else digest)
                out["record_type"].append(fields["WARC-Type"])
                out["refers_to"].append(None if whole else page("WARC-Refers-To"))
                out["payload"].append(payload if whole else None)
                out["intact"].append(not whole or base32_sha1(payload) == digest)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return dealt.mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a new archive of pages in the shared folder."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
