"""WARC records in seekable Zstandard bundles.

Pages become response or revisit records: of the rows with equal payloads the one with the largest page id is
the response, the others revisit it. Only ids and digests are shuffled to decide that; page rows move once,
to meet their decision.

A bundle is one seekable Zstandard file: records are grouped into independent frames of about
``FRAME_BYTES``, and the footer is a skippable frame with the compressed and uncompressed size of every
frame. Any Zstandard reader can decompress a bundle from the start; a record is read alone by its frame and
its offset in the frame. Bundles are rows (``bundle``, ``data``) of a Parquet table in the shared folder, so
that Spark's commit protocol covers lost executors and every file system works; ``index`` maps record ids
to frames and offsets. ``export_bundles`` writes the same bytes as ``.warc.zst`` files.

Defined results: a null html is an empty payload; a null id counts as the smallest and is written as an empty
page id; null urls have no target header. Of rows that repeat page id and payload the first by url is
the response, if one of them must be. An empty table gives no records. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import written

FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 8 * 1024 * 1024
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

BUNDLES = "bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"
RECORDS = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint"
)


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def encode_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, rid: str
) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only, its payload is in the record it refers to.

    Escapes of the URL stay as they are; characters that no URI may hold are escaped. All records have one date, since pages have none.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=~-._%''')}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")  # the first copy is the response
        head.append(f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Headers, HTTP length and payload of the record at ``at``, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(http.rpartition(b"Content-Length: ")[2])
    return {"head": head, "stated": stated, "payload": payload}, end + 4 + length + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with (compressed, uncompressed) sizes, number of frames, flags, magic number."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, uncompressed size) of every frame, from the footer alone."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end")
    start, at, table = len(bundle) - 9 - 8 * frames, 0, []
    for packed, plain in struct.iter_unpack("<II", bundle[start:-9]):
        table.append((at, packed, plain))
        at += packed
    return table


def read_frame(bundle: bytes, frame: int, table: list[tuple[int, int, int]] | None = None) -> bytes:
    at, packed, plain = (table or read_seek_table(bundle))[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(1, plain))


class _Bundle:
    """A bundle being filled: whole frames, the open frame and where each record lies."""

    def __init__(self, name: str):
        self.name, self.packed, self.sizes, self.size = name, [], [], 0
        self.open, self.open_size, self.records = [], 0, []

    def add(self, rid: str, record: bytes) -> None:
        self.records.append((rid, len(self.sizes), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.open))
            self.packed.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def row(self) -> pa.RecordBatch:
        self.close_frame()
        ids, frames, offsets, lengths = zip(*self.records, strict=True)
        columns = [[self.name], [b"".join(self.packed) + seek_table(self.sizes)], [ids], [frames], [offsets], [lengths]]
        kinds = [pa.string(), pa.binary(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["bundle", "data", "record_ids", "frames", "offsets", "lengths"],
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, payload, digest hex, refers_to, revisit, copy) into bundles, one at a time."""
    part, number, bundle = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        for page_id, url, payload, sha1, refers_to, revisit, copy in zip(*(c for c in batch.columns), strict=True):
            page_id, payload, digest = page_id.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
            rid = record_id(page_id, digest, copy.as_py())
            bundle = bundle or _Bundle(f"part-{part:06d}-{number:06d}")
            bundle.add(rid, encode_record(page_id, url.as_py(), payload, digest, refers_to.as_py(), revisit.as_py(), rid))
            if bundle.size >= BUNDLE_BYTES:
                yield bundle.row()
                number, bundle = number + 1, None
    if bundle:
        yield bundle.row()


def decide(rows: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` for each page and payload: the largest page id with that payload.

    ``rows`` has one thin row a page. Equal payloads are counted before they meet (max is combined on the map
    side); the join back may be split by adaptive execution where one payload has very many pages.
    """
    thin = written(rows.select("page_id", "digest").distinct(), "warc-digests")
    largest = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    return thin.join(largest, "digest")


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write every page as a record; returns the bundle table (one row a bundle) read back from storage."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # A key without nulls: join and row number share one exchange of the pages.
    place = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    decided = decide(rows).select(place.alias("place"), "digest", "refers_to")
    copies = Window.partitionBy("place", "digest").orderBy("url")
    met = rows.withColumn("place", place).join(decided, ["place", "digest"]).withColumn("copy", F.row_number().over(copies) - 1)
    response = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("copy") == 0)
    packed = met.select(
        "page_id", "url", "payload", "digest", F.when(~response, F.col("refers_to")).alias("refers_to"),
        (~response).alias("revisit"), "copy",
    ).mapInArrow(_pack, BUNDLES)
    return written(packed, "warc")


def index(bundles: DataFrame) -> DataFrame:
    """``record_id, bundle, frame, offset, length`` of every record; offsets are inside the decompressed frame."""
    each = F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r")
    return bundles.select("bundle", each).select(
        F.col("r.record_ids").alias("record_id"), "bundle", F.col("r.frames").alias("frame"),
        F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"),
    )


def _row(record: dict) -> tuple:
    """A record as a row of ``RECORDS``; the payload digest of a response is computed again."""
    number = lambda x: int(x) if x else None
    head, payload = record["head"], record["payload"]
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    return (number(head["X-Page-ID"]), head.get("WARC-Target-URI"), None if revisit else payload, record["stated"],
            digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of bundles, frame by frame."""
    for batch in batches:
        for data in batch.column(0):
            bundle = data.as_py()
            table = read_seek_table(bundle)
            for frame in range(len(table)):
                text, at, rows = read_frame(bundle, frame, table), 0, []
                while at < len(text):
                    record, at = decode_record(text, at)
                    rows.append(_row(record))
                yield _rows(rows)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of bundles at given places (frame, offset); only the frames that hold one are decompressed."""
    for batch in batches:
        for data, places in zip(batch.column(0), batch.column(1), strict=True):
            bundle, offsets = data.as_py(), defaultdict(list)
            for place in places.as_py():
                offsets[place["frame"]].append(place["offset"])
            table = read_seek_table(bundle)
            for frame in sorted(offsets):
                text = read_frame(bundle, frame, table)
                yield _rows([_row(decode_record(text, at)[0]) for at in sorted(offsets[frame])])


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record of a bundle table with its payload (null for revisits)."""
    return bundles.select("data").mapInArrow(_unpack, RECORDS)


def read_records(bundles: DataFrame, wanted: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The records with the wanted ids, as ``read_archives`` gives them; unknown, null and repeated ids add nothing.

    The index maps ids to places by a join; bundles without a wanted record are not opened, and of the others
    only the frames that hold one. A bundle's list of places is bounded by its records.
    """
    ids = wanted.select(F.col(id_col).alias("record_id")).distinct()
    places = index(bundles).join(ids, "record_id", "left_semi")
    lists = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    return bundles.join(lists, "bundle").select("data", "places").mapInArrow(_pick, RECORDS)


def read_record(bundle: bytes, frame: int, offset: int) -> dict:
    """One record by its place: decompresses a single frame."""
    return decode_record(read_frame(bundle, frame), offset)[0]


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<bundle>.warc.zst`` below a folder that all executors mount; gives name and bytes.

    A file is written under a name of its attempt and then renamed, so a repeated task leaves one whole file.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as file:
                    file.write(data)
                os.replace(file.name, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64())], names=["path", "bytes"])

    os.makedirs(folder, exist_ok=True)
    return bundles.select("bundle", "data").mapInArrow(save, "path string, bytes bigint")
