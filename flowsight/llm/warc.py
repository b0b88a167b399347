"""WARC archives: writing records, reading them back, reassembling segments.

Writing: a page becomes an HTTP response with chunked transfer framing inside a
WARC ``response`` record; pages whose payload repeats one of a larger page id
become ``revisit`` records without payload.  Blocks longer than
``segment_bytes`` are cut: the first segment is the response record, the rest are
``continuation`` records that name its id, their segment number and, on the last
one, the total length.  Archives are gzip-per-record files in the shared folder;
tasks name their files by partition and attempt, and only files that finished
tasks report are read, so a lost executor leaves at most files nobody reads.

Reading: archives are streamed record by record; continuation records are
grouped by origin id, ordered by segment number, checked against the announced
total length, and the chunked framing is decoded.  A worker holds one record,
a group one payload.

Cases: null html counts as empty; null url becomes an empty target; rows with the
same page id and the same payload are each written, all as responses where that id
is the largest; a null page id never beats another; a record with missing or
conflicting segments, a wrong total length or broken framing comes back with
``complete`` false and null payload figures; an empty table writes nothing and
gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.llm.common import map_batches, materialise, prepare, texts_of, work_path

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
READ_AT_ONCE = 1 << 14


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# -------------------------------------------------------------------- framing

def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(body), size):
        part = body[i:i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(data: bytes) -> bytes:
    """Body of chunked framing (extensions and trailers allowed); ValueError
    where it is cut or malformed."""
    out, at = [], 0
    while True:
        eol = data.index(CRLF, at)
        size = int(data[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or data[at + size:at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        out.append(data[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, sep, body = block.partition(CRLF + CRLF)
    if not sep:
        raise ValueError("no end of HTTP headers")
    fields = dict(_fields(head.split(CRLF)[1:]))
    return dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.strip().lower().decode("latin-1"), value.strip().decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records_of(page_id, url, payload: bytes, revisit_of, unique: str, segment_bytes: int,
               chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, unique)}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", "".join((url or "").splitlines()))]
    if page_id is not None:
        common.append(("WARC-Page-ID", str(page_id)))
    digest = ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if revisit_of is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, digest, kind,
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("WARC-Refers-To-Page-ID", str(revisit_of))], http)
        return
    block = http + chunked(payload, chunk_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, digest, kind]
    if len(block) <= segment_bytes:
        yield record(first, block)
        return
    n = -(-len(block) // segment_bytes)
    for k in range(n):
        part = block[k * segment_bytes:(k + 1) * segment_bytes]
        if k == 0:
            yield record([*first, ("WARC-Segment-Number", "1")], part)
            continue
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == n - 1 else []
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{unique}/{k}')}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common,
                      ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k + 1)), *last], part)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a gzip-per-record stream."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or stream.read(READ_AT_ONCE)
            rest = b""
            if not data:
                if out:
                    raise ValueError("archive ends inside a record")
                return
            out.append(z.decompress(data))
        rest = z.unused_data
        whole = b"".join(out)
        head, sep, tail = whole.partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if not sep or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(_fields(lines[1:]))
        yield fields, tail[:int(fields["content-length"])]


# ------------------------------------------------------------------ operators

def _roles(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, body_sha256, revisit_of) of the pages that revisit another."""
    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body = texts_of(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()),
             pa.array([len(x) for x in body], pa.int64())], ["page_id", "sha256", "n"])
    kind = dict(pages.dtypes)["page_id"]
    rows = map_batches(pages.select("page_id", "html"), one, f"page_id {kind}, sha256 binary, n long") \
        .where(F.col("n") >= min_revisit_bytes).select("page_id", "sha256")
    rows = materialise(rows, "warc-digests")
    tops = rows.groupBy("sha256").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1")
    return rows.join(tops, "sha256").where("top is not null and not (page_id <=> top)") \
        .select("page_id", "sha256", F.col("top").alias("revisit_of")).distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   text_col: str = "html", min_revisit_bytes: int = 1000, segment_bytes: int = 1 << 15,
                   chunk_bytes: int = 1 << 13, archive_bytes: int = 1 << 23) -> DataFrame:
    """Write the pages as archives below ``folder``; the manifest (path, records,
    bytes) of the finished archives comes back as a table."""
    prepare(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(text_col).cast("string").alias("html"))
    dup = materialise(_roles(src, min_revisit_bytes), "warc-revisits")
    body = src.withColumn("body", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    if dup.take(1):  # without revisits no text needs to move
        d = dup.select(F.col("page_id").alias("p2"), "sha256", "revisit_of")
        body = body.join(d, F.col("page_id").eqNullSafe(F.col("p2")) & (F.unhex(F.sha2("body", 256)) == F.col("sha256")),
                         "left")
    else:
        body = body.withColumn("revisit_of", F.lit(None).cast("string"))
    body = body.select("page_id", "url", "body", "revisit_of")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        done, out, size, count, row = [], None, 0, 0, 0
        for b in batches:
            for page, url, data, top in zip(*(c.to_pylist() for c in b.columns)):
                row += 1
                for rec in records_of(page, url, data, top, f"{task}/{row}", segment_bytes, chunk_bytes):
                    if out is None:  # an archive may end between the segments of a page
                        path = posixpath.join(root, f"pages-{task}-{len(done):05d}.warc.gz")
                        out, size, count = fs.open_output_stream(path), 0, 0
                    z = _gzip(rec)
                    out.write(z)
                    size, count = size + len(z), count + 1
                    if size >= archive_bytes:
                        out.close()
                        out = done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d)) for d in done], schema=pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
    return materialise(body.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


RECORD_SCHEMA = ("record_id string, kind string, page_id string, url string, refers_to string, digest string, "
                 "origin string, segment int, total long, block binary, payload_bytes long, payload_digest string, "
                 "complete boolean")


def _figures(block: bytes) -> tuple[int | None, str | None, bool]:
    try:
        body = http_payload(block)
        return len(body), hashlib.sha1(body).hexdigest(), True
    except ValueError:
        return None, None, False


def read_archives(manifest: DataFrame, folder: str, files_per_task: int = 4) -> DataFrame:
    """Records of the archives.  Records in one piece have their payload figures at
    once; segments carry their block for reassembly."""
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
                         .get(t, pa.string())) for n, t in (c.split() for c in RECORD_SCHEMA.split(", "))])

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for path in b.column(0).to_pylist():
            rows, held = [], 0
            with fs.open_input_stream(path) as stream:
                for f, block in read_records(stream):
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    whole = number is None and f["warc-type"] == "response"
                    figures = _figures(block) if whole else (None, None, None)
                    rows.append(dict(zip(names, (
                        f["warc-record-id"], f["warc-type"], f.get("warc-page-id"), f.get("warc-target-uri"),
                        f.get("warc-refers-to-page-id"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        f.get("warc-segment-origin-id") or (f["warc-record-id"] if number else None), number, total,
                        block if number else None, *figures))))
                    held += len(block) if number else 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    n = manifest.count()
    paths = manifest.select("path").repartition(max(1, -(-n // files_per_task)), "path")
    return map_batches(paths, one, RECORD_SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole payload figures per origin id: segments in order of their number, each
    number once from 1 on, their lengths adding up to the announced total."""
    groups = segments.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"), F.count("total").alias("totals"))

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for origin, parts, total, totals in zip(*(c.to_pylist() for c in b.columns)):
            whole = b"".join(p["block"] for p in parts)
            good = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and totals == 1 and total == len(whole)
            n, digest, ok = _figures(whole) if good else (None, None, False)
            out.append((origin, n, digest, ok))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.string(), pa.int64(), pa.string(), pa.bool_()))],
            ["origin", "payload_bytes", "payload_digest", "complete"])
    return map_batches(groups, one, "origin string, payload_bytes long, payload_digest string, complete boolean")


def pages_from_archives(records: DataFrame) -> DataFrame:
    """One row per page: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, complete.  A revisit takes its figures from the response that it
    refers to; a digest that differs from the record's own makes it incomplete."""
    r = materialise(records, "warc-records")
    cols = ["page_id", "url", "kind", "refers_to", "digest", "payload_bytes", "payload_digest", "complete"]
    whole = r.where("kind = 'response' and segment is null").select(*cols)
    first = r.where("kind = 'response' and segment = 1").drop("payload_bytes", "payload_digest", "complete")
    parts = reassemble(r.where("segment is not null").select("origin", "segment", "total", "block"))
    responses = whole.unionByName(first.join(parts, "origin").select(*cols))
    targets = responses.where("complete").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("d")) \
        .agg(F.max("payload_bytes").alias("b"))
    revisits = r.where("kind = 'revisit'").drop("payload_bytes", "payload_digest", "complete").join(
        targets, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("d")), "left") \
        .withColumns({"payload_bytes": F.col("b"), "payload_digest": F.col("d"), "complete": F.col("d").isNotNull()})
    every = responses.unionByName(revisits.select(*cols))
    sound = F.col("complete") & (F.col("digest") == F.col("payload_digest"))
    return every.select("page_id", "url", F.col("kind").alias("record_type"),
                        F.when(sound, F.col("payload_bytes")).alias("payload_bytes"),
                        F.when(sound, F.col("payload_digest")).alias("payload_digest"), "refers_to",
                        F.coalesce(sound, F.lit(False)).alias("complete"))


def round_trip(spark: SparkSession, pages: DataFrame, **write_options) -> DataFrame:
    """Write the pages and read every archive back (ids as text come back typed as
    the pages' ids)."""
    folder = work_path(spark, "warc")
    manifest = write_archives(pages, folder, **write_options)
    back = pages_from_archives(read_archives(manifest, folder))
    kind = dict(pages.dtypes)[write_options.get("id_col", "page_id")]
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
