"""WARC archives, index first (operator 10).

Writing gives each page one record in gzip members of .warc.gz files and, beside them, an index table with file, offset,
length, url and digest of each record. Reading starts from the index: any DataFrame filter selects records, the selected
rows are sorted by file and offset, neighbouring byte ranges are coalesced into one read, and each record is parsed from
its range. Of pages with equal payloads of at least `least_bytes` bytes, that of the least page_id is a response; others
are revisit records, which refer to it and carry no payload.

Files lie in a shared folder (any that pyarrow's file systems reach) under names that no other task attempt uses; the
index names only the files of attempts that succeeded, and is written before anything is read, so a lost executor costs
at most files that no index names.

Defined results: a null html is an empty payload; a null url is left out of its record; rows that repeat a page_id each
get a record, and those equal to their response are responses too; a null page_id never becomes another page's
response, is a revisit if a page with an id has its payload, and a response otherwise; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A file is closed beyond this size, and one read is no longer than READ_BYTES unless a single record is.
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20
#: Bytes between two wanted records that are read and thrown away rather than left out.
GAP_BYTES = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder given as a URI or an absolute path, and its path there."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool, digest: str) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says, its payload's size and digest checked against the headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    url = fields.get("WARC-Target-URI")
    return {
        "page_id": page("WARC-Record-ID"), "url": url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, path = file_system(folder)
    out, name, at = None, "", 0
    try:
        for batch in C.slices(batches, "html"):
            rows = []
            for page_id, url, html, response in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "response")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode()
                revisit, digest = response is not None and response != page_id, base32_sha1(payload)
                member = gzip.compress(record(page_id, url, payload, response, revisit, digest), 1, mtime=0)
                out.write(member)
                rows.append((page_id, url, name, at, len(member), digest, "revisit" if revisit else "response"))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of pages (page_id, url, html) and their index to a shared folder; the index."""
    spark = pages.sparkSession
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    least = source.filter(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("response"))
    # joined by another key than the one it is grouped by, so that Spark may split a payload that very many pages have
    least = least.select(F.reverse("_sha").alias("_key"), "response")
    rows = source.withColumn("_key", F.reverse("_sha")).join(least, "_key", "left").select("page_id", "url", "html", "response")
    index = rows.mapInArrow(lambda it: _write(it, folder, file_bytes), _INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, path = file_system(folder)
    name, source = None, None
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    try:
        for batch in batches:
            wanted = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(wanted):
                file, first, size = wanted[k]
                end, to = first + size, k + 1
                while to < len(wanted) and wanted[to][0] == file and wanted[to][1] - end <= GAP_BYTES and wanted[to][1] + wanted[to][2] - first <= READ_BYTES:
                    end, to = max(end, wanted[to][1] + wanted[to][2]), to + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                data = source.read_at(end - first, first)
                rows = [parse(zlib.decompress(data[a - first : a - first + n], 31)) for _, a, n in wanted[k:to]]
                yield pa.RecordBatch.from_pylist(rows, schema)
                k = to
    finally:
        if source is not None:
            source.close()


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows, by coalesced reads of sorted byte ranges; revisits have a null payload."""
    n = C.shuffle_partitions(index.sparkSession)
    wanted = index.select("file", "offset", "length", (F.col("offset") / F.lit(READ_BYTES)).cast("long").alias("part"))
    dealt = wanted.repartition(n, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(lambda it: _read(it, folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def shared_folder(spark, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    C.with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 from the digest's hex, five bits at a time.
OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(encode(coalesce(html, ''))) as hex from pages),
b as (select *, min(page_id) over (partition by hex) as response, cast(cast(unhex(hex) as bit) as varchar) as bits from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_prepend(0, list_transform(range(5), lambda j: (substr(bits, i * 5 + j + 1, 1) = '1')::int * (16 >> j))), lambda a, x: a + x), 1)), '') as payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type, case when page_id <> response then response end as refers_to from b
"""
