"""WARC archives in per-record Zstandard frames with a dictionary in the leading skippable frame.

``write_archives`` turns pages into records (one archive per task, in the folder
given, which all executors share) and marks repeats of a payload as revisits of
the record with the largest page id.  ``read_archives`` streams archives back:
the dictionary comes from the leading skippable frame, each further frame holds
one record, and version line, required headers, content length, closing blank
lines and payload digest are checked; a bad archive raises ``ValueError``.

Defined cases: a null html is an empty payload, a null url ``about:blank``; a null
page id is written as ``none`` and read back as null, and never is the record that
others revisit; rows that repeat the largest page id of a payload are all
responses; an empty table gives no archives; payloads of any length are written
whole; columns beside the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, run_folder
from .common import bound_batches, texts_of

# Fixed values of the file formats.
SKIPPABLE_MAGIC = 0x184D2A5D         # the skippable frame that holds the dictionary
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 32 * 1024
SAMPLE_RECORDS = 256                 # first records of an archive that its dictionary is made from
SAMPLE_BYTES = 4096                  # of each
LEVEL = 3
READ_BYTES = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head but not the payload."""
    name = "none" if page_id is None else page_id
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}",
             f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = head + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Check one record and take it apart."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"missing header {k}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("content length does not match the block")
    http, mark, body = rest[:size].partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r", b""))
    if not mark or not m:
        raise ValueError("bad HTTP head")
    length = int(m[1])
    name = _ID.fullmatch(fields["warc-record-id"])
    ref = _ID.fullmatch(fields.get("warc-refers-to", ""))
    kind, _, sha = fields.get("warc-payload-digest", "").partition(":")
    if not name or kind != "sha1" or fields["warc-type"] not in ("response", "revisit"):
        raise ValueError("bad record headers")
    if fields["warc-type"] == "response":
        if len(body) != length or digest(body) != sha:
            raise ValueError("payload does not match its length or digest")
    elif body or not ref:
        raise ValueError("bad revisit record")
    number = lambda x: None if x is None or x[1] == "none" else int(x[1])
    return {"page_id": number(name), "payload_bytes": length, "payload_digest": sha,
            "record_type": fields["warc-type"], "refers_to": number(ref),
            "url": fields.get("warc-target-uri"),
            "payload": body if fields["warc-type"] == "response" else None}


def make_dictionary(samples: list) -> bytes:
    """A trained dictionary, or the first sample as plain content when there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (samples[0] if samples else b"WARC/1.1\r\n").ljust(8)


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    if raw.startswith(FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    full = raw.startswith(DICTIONARY_MAGIC)
    return zstandard.ZstdCompressionDict(
        raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes records to one stream; the dictionary comes from the first of them."""

    def __init__(self, out):
        self.out, self.waiting, self.packer, self.records = out, [], None, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer is not None:
            self.out.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        if len(self.waiting) >= SAMPLE_RECORDS or sum(map(len, self.waiting[-8:])) > (8 << 20):
            self.start()

    def start(self) -> None:
        if self.packer is None and self.waiting:
            raw = make_dictionary([x[:SAMPLE_BYTES] for x in self.waiting])
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
            self.packer = zstandard.ZstdCompressor(LEVEL, dict_data=load_dictionary(raw), write_checksum=True)
            for x in self.waiting:
                self.out.write(self.packer.compress(x))
            self.waiting = []


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each, holding one frame at a time."""
    buf = stream.read(READ_BYTES)
    if not buf:
        return
    if len(buf) < 8:
        raise ValueError("truncated archive")
    magic, size = struct.unpack("<II", buf[:8])
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame at the start")
    while len(buf) < 8 + size:
        more = stream.read(READ_BYTES)
        if not more:
            raise ValueError("truncated dictionary")
        buf += more
    opener = zstandard.ZstdDecompressor(dict_data=load_dictionary(buf[8:8 + size]))
    buf = buf[8 + size:]
    while True:
        if not buf:
            buf = stream.read(READ_BYTES)
            if not buf:
                return
        one, parts = opener.decompressobj(), []
        while True:
            parts.append(one.decompress(buf))
            if one.eof:
                buf = one.unused_data
                break
            buf = stream.read(READ_BYTES)
            if not buf:
                raise ValueError("truncated frame")
        yield b"".join(parts)


def mark_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): the largest page id of equal payloads is the response.

    Payloads are compared by digest and length; only those seen more than once are
    joined back, a small table beside the pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"_k": F.sha1(F.col("html").cast("binary")), "_n": F.octet_length("html")})
    again = (rows.where(F.col("_n") >= min_bytes).groupBy("_k", "_n")
             .agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
             .where((F.col("_rows") > 1) & F.col("_first").isNotNull()).drop("_rows"))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))
    return rows.join(again, ["_k", "_n"], "left").select(
        "page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one archive per task into ``folder`` (a shared one); (path, records) per archive.

    A task writes to a name of its own and renames at the end, so a repeated task
    replaces its archive.
    """
    bound_batches(pages.sparkSession)
    marked = mark_revisits(pages, min_bytes, id_col, url_col, html_col)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temp = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        records, out = None, None
        for b in batches:
            if out is None and b.num_rows:
                out = fs.open_output_stream(temp, compression=None)
                records = Archive(out)
            for p, u, h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)),
                                  b.column(3).to_pylist(), strict=True):
                records.add(record(p, u, h, r))
        if out is not None:
            records.start()
            out.close()
            path = f"{root}/part-{part:06d}.warc.zst"
            fs.move(temp, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records.records], pa.int64())],
                                             names=["path", "records"])

    return marked.mapInArrow(run, "path string, records long")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                  ("payload", pa.binary())])


def read_archives(paths: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives in column ``path``; ``payload`` False leaves the bodies out."""
    names = [n for n in _ROW.names if payload or n != "payload"]
    schema = pa.schema([_ROW.field(n) for n in names])

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parse(data))
                        held += len(data) if payload else 100
                        if held > (4 << 20):
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    return paths.select("path").mapInArrow(run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives under the shared checkpoint folder and read them back."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    written = cut_lineage(write_archives(pages, folder, min_bytes), "warc-paths")
    archives = max(1, written.count())
    return read_archives(written.repartitionByRange(archives, "path"), folder, payload=False)
