"""WARC files with dictionary-compressed records.

Every file begins with a Zstandard dictionary built from the very records it archives, in a skippable frame (magic 0x184D2A5D, length,
dictionary), followed by each record as a Zstandard frame of its own that uses the dictionary. A record can so be read from its offset
with nothing but the head of its file. A file holds the records of one task up to FILE_BYTES of text; each gets its own dictionary, so memory is
bounded and nothing is gathered. A file is written under a name of its attempt and renamed when complete; its final name follows from its
content, so a task that is run again leaves the same file again.

Defined results for odd input:
* null or empty html: a record with an empty body; a null url: the WARC-Target-URI is left out; line ends and blanks at the ends of a url are dropped;
* very long pages are archived whole (a file takes at least one record, whatever its size);
* repeated rows are records of their own; ties don't arise: records stand in their order in the table;
* an empty table gives no file and no row; records that no dictionary can be trained on (too few, or nothing in common): the last of them, as a dictionary
  without tables;
* extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

MAGIC = 0x184D2A5D
FILE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 9
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, file string, offset long, length long, n_bytes long, digest string"


def record(url: str | None, html: str | None, date: str = DATE) -> tuple[bytes, str]:
    """A WARC resource record and the digest of its body."""
    body = (html or "").encode()
    digest = "sha256:" + hashlib.sha256(body).hexdigest()
    uri = " ".join((url or "").split())
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {date}", *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Block-Digest: {digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on all the records, of an eighth of their size (DICTIONARY_BYTES at most); where that can't be done, a piece of the records themselves."""
    size = max(256, min(size, sum(map(len, records)) // 8))
    try:
        return zstandard.train_dictionary(size, records, k=min(1024, size // 4), d=8, f=20, accel=1, split_point=1.0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records[-16:])[-size:]


def archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """A file's bytes, and the offset and length of each record's frame in it."""
    trained = dictionary(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", MAGIC, len(trained)) + trained)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained))
    places = []
    for r in records:
        at = out.tell()
        out.write(packer.compress(r))
        places.append((at, out.tell() - at))
    return out.getvalue(), places


def unpacker(head: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor for a file that begins with head, and where its records begin."""
    magic, size = struct.unpack_from("<II", head)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    trained = head[8 : 8 + size]
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None), 8 + size


def parse(raw: bytes) -> dict:
    """The url and body of a record, with its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {"url": fields.get("WARC-Target-URI"), "html": rest[: int(fields["Content-Length"])].decode(), "digest": fields["WARC-Block-Digest"]}


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder given as a path or URI: local, or what pyarrow has (s3, gs, abfss; hdfs where libhdfs is installed). Spark's names for these are known."""
    folder = re.sub("^s3[an]://", "s3://", folder)
    if folder.startswith("file:"):
        folder = unquote(urlparse(folder).path)
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _write(folder: str, records: list[bytes]) -> tuple[str, list[tuple[int, int]]]:
    fs, path = _store(folder)
    data, places = archive(records)
    name = f"part-{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
    fs.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, f"{path}/{name}")
    return name, places


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC files in folder (shared by all executors) and returns their index:
    (page_id, file, offset, length, n_bytes, digest), a row for each record, n_bytes being that of the record before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        records: list[bytes] = []
        digests: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            name, places = _write(folder, records)
            arrays = [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array([p for p, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64()), pa.array([len(r) for r in records], pa.int64()), pa.array(digests)]
            batch = pa.RecordBatch.from_arrays(arrays, ["page_id", "file", "offset", "length", "n_bytes", "digest"])
            ids.clear(), records.clear(), digests.clear()
            held = 0
            return batch

        for batch in batches:
            for page_id, url, html in zip(*(batch[c] for c in ("page_id", "url", "html"))):
                r, digest = record(url.as_py(), html.as_py())
                if records and held + len(r) > file_bytes:
                    yield flush()
                ids.append(page_id.as_py())
                records.append(r)
                digests.append(digest)
                held += len(r)
        if records:
            yield flush()

    p = pages.select(common.col("page_id").cast("long").alias("page_id"), common.col("url").cast("string").alias("url"), common.col("html").cast("string").alias("html"))
    return common.materialize(p.mapInArrow(run, SCHEMA), "warc-index")


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, digest) of the records that index names: each is read at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        name, file, packed = None, None, None
        for batch in batches:
            rows = []
            for page_id, f, offset, length in zip(*(batch[c].to_pylist() for c in ("page_id", "file", "offset", "length"))):
                if f != name:
                    file = fs.open_input_file(f"{path}/{f}")
                    head = file.read_at(8, 0)
                    packed, _ = unpacker(head + file.read_at(struct.unpack_from("<II", head)[1], 8))
                    name = f
                rows.append({"page_id": page_id} | parse(packed.decompress(file.read_at(length, offset))))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string())]))

    return index.select("page_id", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, "page_id long, url string, html string, digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_warc(common.read(spark, sf_dir, "pages"), common.table_path(spark, "warc"))
