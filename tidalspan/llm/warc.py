"""WARC: a deterministic sharded writer, and the reader of what it wrote.

Records are range-sorted by page id into blocks, one shuffle of the payloads. Each block is
written to files that roll over at a compressed size; a record is a gzip member of its own, its
headers and digests are made anew from the row, and nothing in a file depends on the clock, the
host or the attempt. A file gets its final name only when it is whole, by a rename from a
temporary name, so a repeated or speculative attempt replaces it with the same bytes. The
manifest, one row a file, is a Spark table that exists when all tasks have succeeded; readers
take the files that it names and check size and digest of each.

Equal payloads of at least min_bytes are stored once: the record with the smallest page id is a
response, the others are revisits of it. Payload digests are aggregated before they are joined
(each in SALTS parts, so that the copies of one payload are not one task), and the roles that
result travel to the blocks beside the pages, not by a join of payloads. A page id that many rows
share (a null one, say) fills several blocks.

Files are reached through pyarrow's file systems under the folder of spark.checkpoint.dir,
which driver and executors share (a local path, HDFS or an object store).

Cases: a null html is an empty payload; a null url is written as urn:page:<id>, and control
characters in urls are escaped; a null page_id sorts first and never becomes the response that
others refer to; rows that repeat the smallest page id of a payload are responses each; an
empty table gives an empty manifest and no rows; further columns are ignored. Temporary files of
attempts that died are deleted when the manifest is there.
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

from tidalspan.llm import ranges, storage, words

ROLL_BYTES = 64 << 20
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
SALTS = 16

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(page_id: int | None, url: str | None) -> str:
    return _clean(url) if url else f"urn:page:{page_id}"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, refers_url: str | None = None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = sha1_base32(payload)
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(page_id, url)), ("Content-Type", HTTP_TYPE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", _uri(refers_to, refers_url)),
            ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to)),
        ]
    return _record(fields, block)


class Writer:
    """Files of one block: each under a temporary name until it is whole."""

    def __init__(self, folder: str, block: int, roll: int) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.block, self.roll, self.number, self.out = block, roll, 0, None

    def add(self, page_id: int | None, record: bytes) -> dict | None:
        """Writes a record; gives the finished file's manifest row if the file is full."""
        if self.out is None:
            self.name = f"pages-{self.block:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.digest, self.size, self.records, self.first = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0, page_id
            info = b"software: tidalspan\r\nformat: WARC File Format 1.1\r\n"
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records, self.last = self.records + 1, page_id
        return self.close() if self.size >= self.roll else None

    def _put(self, record: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        from pyarrow import fs

        final = f"{self.folder}/{self.name}"
        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(final).type != fs.FileType.NotFound:
            self.fs.delete_file(final)  # some stores do not rename onto a file
        self.fs.move(self.temporary, final)
        self.out, self.number = None, self.number + 1
        return {"block": self.block, "file": self.name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest(), "first_page_id": self.first, "last_page_id": self.last}


MANIFEST = "block int, file string, records long, bytes long, sha256 string, first_page_id long, last_page_id long"
_MANIFEST_ARROW = pa.schema([("block", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page_id", pa.int64()), ("last_page_id", pa.int64())])


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, tie, digest, refers_to, refers_url of the pages whose payload an earlier page has."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = storage.stored(pages.select("page_id", F.xxhash64("html").alias("tie"), "url", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes), "warc-digests")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    firsts = storage.stored(slim.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "warc-firsts")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "tie", "digest", "refers_to", "refers_url")


def write(pages: DataFrame, folder: str, blocks: int, min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to folder, which must exist, and returns the manifest."""
    upper = ranges.bounds(pages, "page_id", blocks)
    key = ranges.order_key(F.col("page_id")).alias("_key")
    at = lambda tie: ranges.block(F.col("page_id"), upper, tie, blocks).alias("_block")
    none = F.lit(None)
    tie = F.xxhash64("html")
    rows = pages.select(at(tie), key, tie.alias("_tie"), F.lit(1).alias("_kind"), "page_id", "url", "html", none.cast("long").alias("refers_to"), none.cast("string").alias("digest"))
    # a told row comes just before the pages of its payload
    told = roles(pages, min_bytes).distinct().select(at(F.col("tie")), key, F.col("tie").alias("_tie"), F.lit(0).alias("_kind"), "page_id", F.col("refers_url").alias("url"), none.cast("string").alias("html"), "refers_to", "digest")
    order = rows.unionByName(told).repartition(blocks, "_block").sortWithinPartitions("_block", "_key", "_tie", "_kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        known: dict[str, tuple[int, str | None]] = {}
        known_for = object()

        def close() -> None:
            if writer and (row := writer.close()):
                done.append(row)

        for batch in batches:
            for block, tie, kind, page_id, url, html, refers_to, digest in zip(*(batch.column(i) for i in range(8)), strict=True):
                block, page_id = block.as_py(), page_id.as_py()
                if (page_id, tie.as_py()) != known_for:
                    known, known_for = {}, (page_id, tie.as_py())
                if not kind.as_py():
                    known[digest.as_py()] = refers_to.as_py(), url.as_py()
                    continue
                if writer is None or writer.block != block:
                    close()
                    writer = Writer(folder, block, roll_bytes)
                html = html.as_py()
                target = known.get(hashlib.sha1((html or "").encode("utf-8", "surrogatepass")).hexdigest()) if known else None
                if row := writer.add(page_id, page_record(page_id, url.as_py(), html, *(target or (None,)))):
                    done.append(row)
        close()
        yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST_ARROW)

    columns = ["_block", "_tie", "_kind", "page_id", "url", "html", "refers_to", "digest"]
    manifest = storage.stored(order.select(*columns).mapInArrow(run, MANIFEST), "warc-manifest")
    storage.delete_matching(pages.sparkSession, f"{folder}/.pages-*.tmp")
    return manifest


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(chunk)
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = {}
    for line in lines:
        k, _, v = line.partition(b": ")
        fields[k.decode().lower()] = v.decode("utf-8", "surrogatepass")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


class _Counted:
    """A stream that keeps the digest and size of what is read."""

    def __init__(self, stream) -> None:
        self.stream, self.digest, self.size = stream, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.digest.update(data)
        self.size += len(data)
        return data


def read(manifest: DataFrame, folder: str, tasks: int, with_payload: bool = True) -> DataFrame:
    """One row a page record of the manifest's files; digests and sizes are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        out: list[dict] = []
        held = 0
        for batch in batches:
            for file in batch.to_pylist():
                with system.open_input_stream(f"{at}/{file['file']}", compression=None) as stream:
                    counted, n = _Counted(stream), 0
                    for member in members(counted):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        n += 1
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        if fields["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                            raise ValueError(f"{file['file']}: a payload does not match its digest")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        out.append({
                            "page_id": int(page) if page else None, "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"],
                            "refers_to": int(refers) if refers else None, "payload": payload if with_payload and not refers else None,
                        })
                        held += len(payload) if with_payload else 0
                        if len(out) >= 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_RECORDS_ARROW)
                            out, held = [], 0
                if (n, counted.size, counted.digest.hexdigest()) != (file["records"], file["bytes"], file["sha256"]):
                    raise ValueError(f"{file['file']} is not what the manifest says")
        yield pa.RecordBatch.from_pylist(out, schema=_RECORDS_ARROW)

    return manifest.repartition(tasks, "file").mapInArrow(run, RECORDS)


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder, n = storage.new_folder(spark, "warc"), ranges.count_for(pages, words.partitions(spark))
    manifest = write(pages, folder, n)
    return read(manifest, folder, n, with_payload=False).drop("payload", "url")
