"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of records, and ends in a seek
table (a skippable frame that lists the frames' sizes). The index maps each record to its bundle, its
frame and its place in the unpacked frame, so that one record is read by unpacking one frame.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelsight.llm.common import stage
from parcelsight.sources.sinks import staging_root

#: Unpacked bytes of a frame and packed bytes of a bundle, about; a longer record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
#: Frames that are read by one task.
PART_FRAMES = 32
#: Payloads of at least so many bytes are revisited.
LEAST_REVISIT = 100
#: Fixed values of the seekable format and of WARC.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, bundle string, frame long, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
           is_revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has no body and names the record that has it."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    body = b"" if is_revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, body, place behind) of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    return fields, data[end + 4:end + 4 + size], end + 8 + size


class Bundle:
    """Packs records into frames; the bytes end with the seek table."""

    def __init__(self) -> None:
        self.out, self.frames, self.held, self.size = io.BytesIO(), [], [], 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the unpacked frame, length) that the record gets."""
        if self.held and self.size + len(data) > FRAME_BYTES:
            self._close_frame()
        place = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return place

    def _close_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def finish(self) -> bytes:
        if self.held:
            self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        return self.out.getvalue()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, packed size, unpacked size) of each frame of an open bundle."""
    end = file.seek(0, 2)
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    sizes, at, out = struct.unpack(f"<{2 * count}I", file.read(8 * count)), 0, []
    for packed, whole in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, whole))
        at += packed
    return out


def read_record(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its frame is read and unpacked."""
    files, name = pafs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        at, packed, whole = seek_table(f)[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=whole)
    return parse(data[offset:offset + length])[:2]


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        bundle, rows, name = Bundle(), [], ""

        def put() -> pa.RecordBatch:
            with files.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(bundle.finish())
            ids, *places = zip(*rows, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(p, k) for p, k in zip(places, kinds, strict=True))],
                names=[c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "again")]
            for page_id, url, html, digest, first, again in zip(*columns, strict=True):
                # a name of its own for each attempt: what a lost task has left is in no index
                name = name or f"{uuid.uuid4().hex}.warc.zst"
                place = bundle.add(record(page_id, url, (html or "").encode(), digest, first, again, date))
                rows.append((page_id, f"{folder}/{name}", *place))
                if bundle.out.tell() >= BUNDLE_BYTES:
                    yield put()
                    bundle, rows, name = Bundle(), [], ""
        if rows:
            yield put()
    return run


def write_warc(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z",
               least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the records' index.

    ``folder`` is one that all executors share. Null html is an empty payload, a null url no URI. Of equal
    payloads of at least ``least`` bytes the row with the smallest page_id is the response, the others are
    revisits of it; rows that repeat this very id with this payload are responses too. A null page_id
    comes last and is a revisit where another row has an id; among null ids alone all are responses. Other
    columns are not read. An empty table writes no bundle and returns an empty index.
    """
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"),
                        F.octet_length(html).cast("long").alias("n"))
    firsts = (rows.filter(F.col("n") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
              .filter("times > 1 and first is not null").select("digest", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", "first",
                                                        again.alias("again"))
    return stage(marked.mapInArrow(_write(folder, date), _INDEX), "warc-index")


def _read(part_frames: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        number = re.compile(r"<urn:page:(-?\d*)>")
        for batch in batches:
            for path, part in zip(*(batch.column(c).to_pylist() for c in ("bundle", "part")), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    for place, packed, whole in seek_table(f)[part * part_frames:(part + 1) * part_frames]:
                        f.seek(place)
                        data, at, rows = unpack.decompress(f.read(packed), max_output_size=whole), 0, []
                        while at < len(data):
                            fields, body, at = parse(data, at)
                            kind = fields["WARC-Type"]
                            own = number.fullmatch(fields["WARC-Record-ID"])[1]
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"damaged record {own} in {path}")
                            refers = number.fullmatch(fields["WARC-Refers-To"])[1] if kind == "revisit" else None
                            rows.append((int(own) if own else None, fields.get("WARC-Target-URI"),
                                         int(fields["X-Payload-Length"]), digest, kind,
                                         int(refers) if refers else None, body))
                        ids, urls, sizes, digests, kinds, refs, bodies = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(sizes, pa.int64()),
                             pa.array(digests), pa.array(kinds), pa.array(refs, pa.int64()),
                             pa.array(bodies, pa.binary())],
                            names=["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                   "refers_to", "payload"])
    return run


def read_warc(index: DataFrame, part_frames: int = PART_FRAMES) -> DataFrame:
    """All records of the bundles that an index names; a response's body is checked against its digest.

    Ranges of frames are handed out, a partition for each, so that neither many bundles nor a large one is read in one task.
    """
    parts = stage(index.select("bundle", F.floor(F.col("frame") / part_frames).alias("part")).distinct(), "warc-parts")
    return parts.repartition(max(1, parts.count())).mapInArrow(_read(part_frames), "page_id long, url string, payload_bytes long, payload_digest string, "
                                     "record_type string, refers_to long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles beside the staged tables, as a URI."""
    root = staging_root(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/warc-{uuid.uuid4().hex}"
