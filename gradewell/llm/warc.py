"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader (operator 12).

* Writer: every task writes its pages as WARC/1.1 records into archives that are one gzip
  stream each (the form many crawls come in), rolled at ``roll`` bytes of records. Of records
  with equal payloads (SHA-1) of at least ``least`` bytes, that with the largest page_id is a
  response, the others are revisit records without a payload.
* Normaliser: a task inflates an archive's stream once, in pieces, finds the records by their
  Content-Length and writes each as a gzip member of its own; offset, length and headers of every
  member go to a sidecar index beside the new archive. Nothing of a record but its headers is held.
* Reader: a task goes through an archive's sidecar, fetches each member by offset and length,
  inflates it alone and takes the result from the record itself; a response's digest is worked out
  from its payload and held against its header.

Files are written by pyarrow's file systems (local and mounted folders, hdfs, s3, gs) to the
shared folder that the cluster names. Each attempt of a task writes files of its own name; the list of
files is a table that Spark commits, so what a lost attempt left behind is never read.

Defined cases: a null html is an empty payload, and empty payloads equal each other; a null url
gives a record without a target; line ends and other control bytes of a url are percent-coded; a null
page_id is never referred to, and revisits a copy that has a page_id; rows that share the
largest page_id of a payload are all responses; no pages give no rows; further columns
are ignored. A truncated or damaged archive raises an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.common import partitions, store
from gradewell.session import scratch_path

ROLL = 64 << 20
PIECE = 1 << 20
GZIP = 31  # zlib's window for a gzip container
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of fetch
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str):
    """(file system, path) of a folder given as a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def quoted(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id, url, payload: bytes, refers_to, revisit: bool, date: str = DATE) -> list[bytes]:
    """Byte pieces of a response or revisit record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}").encode() + END
    block = len(http) + (0 if revisit else len(payload))
    name = "" if page_id is None else page_id
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quoted(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return ["\r\n".join(head).encode() + END, http, b"" if revisit else payload, END]


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Monolith:
    """One archive file, written as a single gzip stream."""

    def __init__(self, folder: str):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}.warc.gz"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
        self.size = self.records = 0

    def add(self, pieces: list[bytes]) -> None:
        for p in pieces:
            self.out.write(self.z.compress(p))
            self.size += len(p)
        self.records += 1

    def close(self):
        self.out.write(self.z.flush())
        self.out.close()
        return self.path.rsplit("/", 1)[1], self.records


class Inflated:
    """The bytes of a gzip file (of one or many members), inflated once and in order."""

    def __init__(self, stream, name: str):
        self.stream, self.name, self.held, self.raw = stream, name, bytearray(), b""
        self.z, self.within = zlib.decompressobj(GZIP), False

    def _more(self) -> bool:
        while True:
            raw = self.raw or self.stream.read(PIECE)
            if not raw:
                if self.within:
                    raise ValueError(f"{self.name}: ends within its gzip stream")
                return False
            try:
                got = self.z.decompress(raw, 4 * PIECE)
            except zlib.error as e:
                raise ValueError(f"{self.name}: {e}") from e
            self.raw, self.within = self.z.unconsumed_tail, not self.z.eof
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(GZIP)
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Up to and with the next blank line; None at the end."""
        at, done = -1, 0
        while (at := self.held.find(END, max(0, done - 3))) < 0:
            done = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError(f"{self.name}: ends within a record's headers")
                return None
        out = bytes(self.held[:at + 4])
        del self.held[:at + 4]
        return out

    def body(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError(f"{self.name}: ends within a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


INDEX = ("offset", "length", "warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")


def normalise_file(source, out, name: str):
    """Rewrite an archive's records as members of ``out``; returns the index's rows."""
    rows, at, stream = [], 0, Inflated(source, name)
    while (head := stream.head()) is not None:
        own = fields(head)
        if "content-length" not in own:
            raise ValueError(f"{name}: a record without Content-Length")
        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        size = out.write(z.compress(head))
        for piece in stream.body(int(own["content-length"]) + len(END)):
            size += out.write(z.compress(piece))
        size += out.write(z.flush())
        rows.append((at, size, *(own.get(k, "-") or "-" for k in INDEX[2:])))
        at += size
    return rows


def _table(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [()] * len(schema), schema)], [n for n, _ in schema])


FILES = [("file", pa.string()), ("records", pa.int64())]


def _write(folder: str, roll: int):
    def run(batches):
        now = None
        for b in batches:
            for page, url, html, keeper in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "keeper"))):
                now = now or Monolith(folder)
                now.add(record(page, url, (html or "").encode(), keeper, keeper is not None))
                if now.size >= roll:
                    yield _table([now.close()], FILES)
                    now = None
        if now:
            yield _table([now.close()], FILES)
    return run


def _normalise(source: str, target: str):
    def run(batches):
        src, old = open_folder(source)
        dst, new = open_folder(target)
        dst.create_dir(new, recursive=True)
        for b in batches:
            for file in b.column("file").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                with src.open_input_stream(f"{old}/{file}", compression=None) as inp, dst.open_output_stream(f"{new}/{name}", compression=None) as out:
                    rows = normalise_file(inp, out, file)
                with dst.open_output_stream(f"{new}/{name}.idx", compression=None) as out:
                    out.write("".join("\t".join(map(str, r)) + "\n" for r in (INDEX, *rows)).encode())
                yield _table([(name, len(rows))], FILES)
    return run


RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
          ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
          ("payload", pa.binary())]


def read_member(raw: bytes, name: str):
    """(page_id, url, payload size, digest, type, refers to, payload) of one record's member."""
    whole = zlib.decompress(raw, GZIP)
    end = whole.index(END) + 4
    own = fields(whole[:end])
    block = whole[end:end + int(own["content-length"])]
    at = block.index(END) + 4
    digest = own["warc-payload-digest"].removeprefix("sha1:")
    revisit = own["warc-type"] == "revisit"
    payload = None if revisit else block[at:]
    size = int(fields(block[:at])["content-length"])
    if not revisit and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{name}: a payload differs from its digest")
    number = lambda v: int(v[len("<urn:page:"):-1]) if v and v != "<urn:page:>" else None
    return number(own["warc-record-id"]), own.get("warc-target-uri"), size, digest, own["warc-type"], number(own.get("warc-refers-to")), payload


def sidecar(raw: bytes) -> list[list[str]]:
    return [line.split("\t") for line in raw.decode().splitlines()[1:]]


def _read(folder: str, payloads: bool):
    def run(batches):
        fs, top = open_folder(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                with fs.open_input_stream(f"{top}/{file}.idx", compression=None) as f:
                    index = sidecar(f.read())
                rows, held = [], 0
                with fs.open_input_file(f"{top}/{file}") as f:
                    for line in index:
                        offset, length = int(line[0]), int(line[1])
                        f.seek(offset)
                        *own, payload = read_member(f.read(length), file)
                        rows.append((*own, file, offset, length, payload if payloads else None))
                        held += len(payload or b"") if payloads else 100
                        if held > PIECE:
                            yield _table(rows, RECORD)
                            rows, held = [], 0
                yield _table(rows, RECORD)
    return run


def _dealt(files: DataFrame) -> DataFrame:
    """Archives over tasks; each is at most about ``roll`` bytes and one record."""
    return files.repartition(partitions(files.sparkSession))


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write pages as monolithic archives into ``folder``; returns the table of files."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    text = F.coalesce("html", F.lit("")).cast("binary")
    own = own.withColumn("digest", F.when(F.octet_length(text) >= least, F.sha1(text)))
    copies = (own.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("m"))
              .where("m > 1 AND digest IS NOT NULL AND keeper IS NOT NULL").select("digest", "keeper"))
    rows = own.join(copies.hint("shuffle_hash"), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper"))
    return store(rows.mapInArrow(_write(folder, roll), "file string, records long"), "warc-files")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the archives of ``source`` into ``target`` with one gzip member a record and a
    sidecar index each; returns the table of the new files."""
    return store(_dealt(files).mapInArrow(_normalise(source, target), "file string, records long"), "warc-members")


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the normalised archives, by their sidecars."""
    return _dealt(files).mapInArrow(_read(folder, payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                                             "refers_to long, file string, offset long, length long, payload binary")


def op12_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scratch_path(spark, f"llm-warc-{uuid.uuid4().hex[:12]}")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{top}/monoliths")
    members = normalise(files, f"{top}/monoliths", f"{top}/members")
    return read_archives(members, f"{top}/members", payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle(least: int = 0) -> str:
    """DuckDB SQL for the query's rows."""
    five = "list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) << (4 - j))) AS INTEGER), 1))"
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: right(bin(16 + instr('0123456789abcdef', substr(h, i + 1, 1)) - 1), 4)), '') AS bits FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string({five}, '') AS payload_digest,
  CASE WHEN payload_bytes >= {least} AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k"""
