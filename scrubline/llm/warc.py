"""WARC archives, one Zstandard frame a record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import smallest
from scrubline.storage import new_path, write_table

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
VERSION = "WARC/1.1"
RECORD_TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Rows, bytes of each, and bytes of the dictionary that compression is tuned on.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 14, 1 << 15
#: A frame is fed to its decoder in pieces of so many bytes.
PIECE = 1 << 13
#: A file is closed once it has so many compressed bytes.
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_uri string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id, url, payload: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit record of the same headers without the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if refers_to is None else b"")
    name = "none" if record_id is None else record_id
    # A line break in a URL would end the header.
    target = "".join("%%%02X" % ord(c) if c in "\r\n%" else c for c in url or "")
    lines = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_header(dictionary: bytes) -> bytes:
    """The leading skippable frame, which holds the dictionary as a frame of its own."""
    packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed


def load_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and the position of its first record."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    body = bytes(data[8:8 + size])
    if struct.unpack_from("<I", body)[0] == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if struct.unpack_from("<I", body)[0] != DICTIONARY_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the frames of an archive, each decoded alone."""
    dictionary, at = load_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        frame, start, content = reader.decompressobj(), at, []
        while not frame.eof and at < len(data):
            content.append(frame.decompress(view[at:at + PIECE]))
            at += PIECE
        if not frame.eof:
            raise ValueError(f"the frame at {start} is cut off")
        yield start, b"".join(content)
        at = min(at, len(data)) - len(frame.unused_data)


def _page_of(uri: str | None) -> str | None:
    """The digits in an id that ``record_bytes`` wrote, empty for a page without id; None for other ids."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+|none)>", uri or "")
    return found and found[1].replace("none", "")


def _check_digest(stated: str | None, content: bytes, what: str) -> None:
    """Base 32 SHA-1 is compared; other algorithms and spellings are taken as they are."""
    if stated and re.fullmatch("sha1:[A-Z2-7]{32}", stated) and stated != f"sha1:{digest_of(content)}":
        raise ValueError(f"the {what} digest differs")


def parse_record(content: bytes) -> tuple:
    """A row of RECORD from the bytes of one frame, after checking headers, lengths and digests.

    All eight types of records are taken. ``record_id`` and ``refers_to`` are null for ids of other
    writers, which ``record_uri`` has as they stand.
    """
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit a block of {len(rest) - 4} bytes")
    block = rest[:length]
    _check_digest(fields.get("warc-block-digest"), block, "block")
    kind, inner, payload = fields["warc-type"], {}, block
    if kind not in RECORD_TYPES:
        raise ValueError(f"unknown record type {kind}")
    # Of a message of HTTP the payload is its body; other blocks are payloads as they are.
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http") and block:
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP headers")
        for line in http.decode("latin-1").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            inner[name.strip().lower()] = value.strip()
    digest, size = fields.get("warc-payload-digest"), len(payload)
    encoded = "transfer-encoding" in inner  # its body is not yet the payload that lengths and digests mean
    if "content-length" in inner and not encoded:
        size = int(inner["content-length"])
    if kind == "revisit":
        if payload or not fields.keys() & {"warc-refers-to", "warc-refers-to-target-uri"}:
            raise ValueError("a revisit holds a payload or refers to nothing")
    elif len(payload) != size:
        raise ValueError(f"the payload has {len(payload)} bytes, its header says {size}")
    elif not encoded:
        _check_digest(digest, payload, "payload")
    own = _page_of(fields["warc-record-id"])
    url = fields.get("warc-target-uri")
    if url is not None and own is not None:  # the escapes of ``record_bytes``
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    if digest is None and kind != "revisit":
        digest = digest_of(payload)
    target = _page_of(fields.get("warc-refers-to"))
    return (int(own) if own else None, url, kind, int(target) if target else None, size,
            digest and digest.removeprefix("sha1:"), fields["warc-record-id"], None if kind == "revisit" else payload)


def train_dictionary(pages: DataFrame, payload: str) -> bytes:
    """A dictionary from at most SAMPLE_ROWS payloads, the first by a hash, SAMPLE_BYTES of each.

    It only decides how well records compress. Too small samples give a raw dictionary of a few
    fixed header bytes.
    """
    text = F.col(payload)
    texts = pages.where(text.isNotNull()).select(F.substring(text, 1, SAMPLE_BYTES // 4).alias("t"))
    sample = smallest(texts, F.xxhash64("t"), ["t"], SAMPLE_ROWS, texts.count()).collect()
    bodies = [record_bytes(i, "http://example.com/", r["t"].encode()) for i, r in enumerate(sample)]
    while bodies and len(bodies) < 64:
        bodies += bodies
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, bodies).as_bytes()
    except zstandard.ZstdError:
        plain = [record_bytes(i, f"http://example.com/{i}", b"<!DOCTYPE html><html><head><title>%d" % (i * 7919)) for i in range(256)]
        return zstandard.train_dictionary(1024, plain).as_bytes()


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
    min_revisit_bytes: int = 0,
) -> tuple[str, DataFrame]:
    """Write a record per row into ``.warc.zst`` files of a new folder in the shared directory.

    Returns the folder and the table (path, records, bytes) of its files. Among the rows with equal
    payloads of at least ``min_revisit_bytes`` bytes that with the largest page id is the response
    and the others revisit it. A null payload is an empty one, a null URL is left out; rows without
    an id are responses and nothing refers to them. Of rows with the same id and payload one is the
    response if it has the largest id and the rest revisit it.

    Digests are grouped before anything is joined, so a payload that a third of all pages share is
    one row there. Files are named by task attempt: a task that is repeated leaves files that the
    table does not list. The folder must be one that pyarrow's file systems can write.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("record_id"), F.col(url).alias("url"), body.alias("payload"),
    ).withColumn("_digest", F.sha1("payload"))
    eligible = F.octet_length("payload") >= min_revisit_bytes
    groups = rows.where(eligible & F.col("record_id").isNotNull()).select("_digest", "record_id").groupBy("_digest").agg(
        F.max("record_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1").select(F.col("_digest").alias("_key"), "_first")
    groups = write_table(groups, "payload-groups")
    # Only the row with the largest id and its equals can be the response: one of them is.
    joined = rows.join(groups, F.col("_digest") == F.col("_key"), "left")
    refers = F.when(F.col("record_id") != F.col("_first"), F.col("_first"))
    repeated = rows.where(eligible & F.col("record_id").isNotNull()).groupBy("_digest", "record_id").agg(
        F.count(F.lit(1)).alias("_same")).where("_same > 1")
    if repeated.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("_first", "record_id").orderBy("url"))
        top = joined.where(F.col("record_id") == F.col("_first")).withColumn("_nth", nth)
        rest = joined.where(F.col("_first").isNull() | F.col("record_id").isNull() | (F.col("record_id") != F.col("_first")))
        joined = top.unionByName(rest.withColumn("_nth", F.lit(1)))
        refers = F.when((F.col("record_id") != F.col("_first")) | (F.col("_nth") > 1), F.col("_first"))
    records = joined.select("record_id", "url", "payload", refers.alias("refers_to"))
    dictionary = train_dictionary(pages, payload)
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file:{folder}")
        fs.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True
        )
        out, path, count, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((path, count, size))

        for batch in batches:
            ids, urls, bodies, refs = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, count, size = fs.open_output_stream(path, compression=None), 0, 0
                    size += out.write(archive_header(dictionary))
                size += out.write(packer.compress(record_bytes(
                    ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), refs[i].as_py()
                )))
                count += 1
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([
            pa.array([d[0].rpartition("/")[2] for d in done], pa.string()),
            pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
        ], ["file", "records", "bytes"])

    return folder, write_table(records.mapInArrow(write, "file string, records long, bytes long"), "warc-files")


def read_archives(spark, folder: str, files: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, payload_digest, record_uri, payload) of all
    records, also of other writers and types.

    ``folder`` holds ``.warc.zst`` files; ``files`` (file) names those to read, else all are. Each
    file is decoded in one task, frame by frame; a record that fails a check fails the job, naming
    the file and the position. Without ``payloads`` the payloads are checked and left out.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content"
    )
    if files is not None:
        found = found.join(files.select("file"), "file", "left_semi")
    columns = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    kept = columns if payloads else columns[:-1]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], types[i]) for i in range(len(kept))], kept
            )

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for at, frame in frames(content.as_buffer().to_pybytes()):
                    try:
                        rows.append(parse_record(frame))
                    except (ValueError, KeyError, UnicodeDecodeError) as e:
                        raise ValueError(f"{name.as_py()}, frame at {at}: {e}") from e
                    held += len(frame)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return found.mapInArrow(decode, ", ".join(f for f in RECORD.split(", ") if f.split()[0] in kept))
