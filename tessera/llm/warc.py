"""WARC archives, index first.

``write_archives`` lets every task write archives of its own (a gzip member for each record) and returns the index:
file, offset, length, URL, digest and kind of each record, which is stored as Parquet beside the archives.
``read_records`` takes any selection of index rows, sorts them by place, joins neighbouring byte ranges into
one read and parses the records out of it.

Of records with equal payloads that with the smallest id is a response and the others are revisits of it.  The
archives lie in the shared folder that the cluster names.  A task's files have names of their own, and only the
index says which ones count: what a failed or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, slices, tune

#: An archive is closed at this size.
ARCHIVE_BYTES = 1 << 30
#: Neighbouring records are read at once up to this size, over gaps of at most so many bytes.
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Records of an archive are dealt to readers by stretches of this size, about one to a task.
STRETCH_BYTES = 8 << 20
#: Payloads smaller than this are always responses.
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
INDEX = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, file string, offset long, length long"


def open_fs(uri: str):
    """(file system, path) of a URI, as pyarrow knows them (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, str]:
    """(record, payload digest); ``first`` is the page that this one revisits."""
    digest = base32(hashlib.sha1(payload).digest())
    name = f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", one_line(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if first is not None:
        fields += [("WARC-Refers-To", f"<urn:x-page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return record(fields, http if first is not None else http + payload), digest


def page_number(name: str | None) -> int | None:
    prefix = "<urn:x-page:"
    return int(name[len(prefix) : -1]) if name and name.startswith(prefix) else None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, first) of the rows that revisit the smallest id with the same payload."""
    keys = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n")).where((F.col("n") >= least) & F.col("page_id").isNotNull()).drop("n")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    return keys.join(groups, "digest").where("page_id > first").distinct()


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row below ``folder`` (a URI all executors reach) and return the stored index.

    Null html is an empty payload; a null URL leaves the field out; a row without id is a response nobody
    refers to; repeated rows of the smallest id are all responses.  Other columns are ignored.  An empty table
    gives an empty index.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    typed = keyed.join(revisits(rows, min_revisit_bytes), ["page_id", "digest"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, place, name = None, 0, ""
        cols: list[list] = [[] for _ in range(8)]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        try:
            for batch in slices(batches, "html", 4_000_000):
                for p, u, h, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is not None and place >= archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        place = len(info)
                    payload = h.encode("utf-8", "surrogatepass")
                    data, digest = page_record(p, u, payload, first)
                    data = member(data)
                    out.write(data)
                    for c, v in zip(cols, (p, u, "response" if first is None else "revisit", digest, len(payload), name, place, len(data)), strict=True):
                        c.append(v)
                    place += len(data)
        finally:
            if out is not None:
                out.close()
        # only a task whose archives are closed says where its records are
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    typed.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit has no payload of its own (null); its length and digest are those of the full payload.  A record
    whose digest is wrong fails the job.
    """
    places = index.select("file", "offset", "length").where("file is not null")
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = places.repartition(max(1, -(-total // STRETCH_BYTES)), F.col("file"), stretch).sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """(file, begin, end, records) of each read."""
        now: tuple[str, int, int, list] | None = None
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] == file and offset - now[2] <= GAP_BYTES and offset + length - now[1] <= READ_BYTES:
                    now[3].append((offset, length))
                    now = (file, now[1], max(now[2], offset + length), now[3])
                else:
                    if now:
                        yield now
                    now = (file, offset, offset + length, [(offset, length)])
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        file, source = None, None
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for name, begin, end, records in ranges(batches):
            if name != file:
                if source is not None:
                    source.close()
                file, source = name, fs.open_input_file(f"{base}/{name}")
            data = source.read_at(end - begin, begin)
            cols: list[list] = [[] for _ in names]
            for offset, length in records:
                fields, block = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
                    raise ValueError(f"record at {name}:{offset} is damaged")
                row = (page_number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, page_number(fields.get("warc-refers-to")), payload if kind == "response" else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def new_folder(df: DataFrame) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
