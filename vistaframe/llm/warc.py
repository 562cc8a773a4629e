"""WARC archives: written as one gzip stream each, then normalised to a member for each record.

The normaliser inflates a whole-file stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of offsets, so that records can be read one by one. Archives and indexes are
files in a folder that all executors share; each file is written under a temporary name and then moved,
so a task that is run again changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import listed, shared_dir, written

CHUNK = 1 << 20
LEVEL = 3
#: Records read back at once.
READ_ROWS = 4096


def opened(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


class _Out:
    """A file that gets its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.part, compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, row: int) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {row} {url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its members; memory is bounded by the chunks."""
    z = zlib.decompressobj(31)
    for c in chunks:
        while c:
            out = z.decompress(c, CHUNK)
            if out:
                yield out
            if z.eof:
                c, z = z.unused_data, zlib.decompressobj(31)
            else:
                c = z.unconsumed_tail
    rest = z.flush()
    if rest:
        yield rest


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records of a byte stream, by their Content-Length."""
    held = bytearray()
    need = None
    for p in parts:
        held += p
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _chunks(uri: str) -> Iterator[bytes]:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            yield data


def write_monolithic(rows: Iterator[tuple], uri: str) -> int:
    n, z = 0, zlib.compressobj(LEVEL, wbits=31)
    with _Out(uri) as f:
        for n, (page_id, url, payload, refers_to) in enumerate(rows, 1):
            f.write(z.compress(record(page_id, url, payload, refers_to, n)))
        f.write(z.flush())
    return n


def normalise(source: str, target: str) -> int:
    """Rewrites the archive with a member for each record and writes `target`.idx: a line of JSON each."""
    at, n = 0, 0
    with _Out(target) as f, _Out(target + ".idx") as index:
        for r in records(inflated(_chunks(source))):
            z = zlib.compressobj(LEVEL, wbits=31)
            member = z.compress(r) + z.flush()
            f.write(member)
            h = headers(r[: r.index(b"\r\n\r\n")])
            index.write(json.dumps({"offset": at, "length": len(member), "type": h["warc-type"], "digest": h["warc-payload-digest"], "uri": h["warc-target-uri"]}).encode() + b"\n")
            at, n = at + len(member), n + 1
    return n


def read_indexed(uri: str) -> Iterator[dict]:
    """The archive's records, each by its offset; payloads of responses are checked against their digest."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f, io.TextIOWrapper(io.BufferedReader(fs.open_input_stream(path + ".idx", compression=None))) as index:
        for line in index:
            entry = json.loads(line)
            r = zlib.decompress(f.read_at(entry["length"], entry["offset"]), 31)
            end = r.index(b"\r\n\r\n")
            h, body = headers(r[:end]), r[end + 4 : -4]
            http, _, payload = body.partition(b"\r\n\r\n")
            said = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] == "response" and digest(payload) != said:
                raise ValueError(f"a payload of {uri} doesn't have its digest")
            yield {
                "page_id": h["x-page-id"] or None,
                "payload_bytes": int(headers(http)["content-length"]),
                "payload_digest": said,
                "record_type": h["warc-type"],
                "refers_to": h.get("x-refers-to-page-id"),
            }


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives; returns their file URIs (file), normalised.

    Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the
    response and the others revisit it; smaller ones are all responses. A null html is an empty payload. A
    null page_id comes before all others; where all are null, all are responses. Rows with the largest
    page_id twice are both responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    groups = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    again = written(groups.where("n > 1 AND last IS NOT NULL").select("sha", "last"))
    # ids go through Python as text: pandas has no exact integers beside nulls
    refers = F.expr("CASE WHEN page_id IS DISTINCT FROM last THEN CAST(last AS STRING) END").alias("refers_to")
    joined = rows.join(listed(again), "sha", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", refers)

    def archive(batches):
        uri = f"{folder}/whole/part-{TaskContext.get().partitionId():06d}.warc.gz"
        rows = ((i, u, h.encode(), r) for b in batches for i, u, h, r in zip(b.page_id, b.url, b.html, b.refers_to))
        yield pd.DataFrame({"file": [uri], "n": [write_monolithic(rows, uri)]})

    def rewrite(batches):
        for b in batches:
            for uri in b.file:
                target = uri.replace("/whole/", "/records/")
                yield pd.DataFrame({"file": [target], "n": [normalise(uri, target)]})

    whole = written(joined.mapInPandas(archive, "file string, n long").where("n > 0"))
    files = written(_spread(whole).mapInPandas(rewrite, "file string, n long"))
    fs, path = opened(f"{folder}/whole")
    if files.limit(1).count():
        fs.delete_dir(path)  # only the normalised archives are read from here on
    return files


def _spread(files: DataFrame) -> DataFrame:
    """A task for each few files."""
    return files.repartition(max(1, min(files.count(), 4096)), "file")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches):
        for b in batches:
            for uri in b.file:
                rows = read_indexed(uri)
                while some := list(islice(rows, READ_ROWS)):
                    yield pd.DataFrame(some)

    rows = _spread(files).mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})

