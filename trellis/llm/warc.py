"""WARC archives of one Zstandard frame a record, with the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed if
that is shorter; every record follows as one frame with its content size and checksum. The dictionary is
trained here on a bounded sample of payloads (``SAMPLE`` rows of least digest).

Of records with equal payloads the one of the largest page_id is a response, the rest are revisits that
refer to it and keep only the HTTP head. The reader finds everything in the archives: it checks magic
numbers, frame ends and sizes, the WARC version line, required headers, lengths, block and payload digests.

Archives are built by tasks and written through pyarrow's file systems under a name of their own per
attempt; only those that a finished task reported are read, through Spark's binaryFile source.

Defined cases: null html: an empty payload; null url: no target header; a null page_id is written as such and
is a response only where no equal payload has an id; repeated rows of the largest page_id: all responses;
empty table: no archive, no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stash

MAGIC = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
#: The dictionary, a model of the payloads, is trained on so many of them, of each at most so many characters; what
#: archives hold is all of every payload whatever the dictionary is.
SAMPLE, SAMPLE_CHARS = 500, 16384
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 16 << 20
RECORD = "archive string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadArchive(ValueError):
    """An archive that breaks the format; says where."""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str | None, where: str) -> int | None:
    if not urn or not urn.startswith("<urn:page:") or not urn.endswith(">"):
        raise BadArchive(f"{where}: bad record id {urn!r}")
    found = urn[10:-1]
    return None if found == "null" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC/1.1 record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes, where: str) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep:
            raise BadArchive(f"{where}: header line without a colon")
        out[name.decode("ascii").strip().lower()] = value.decode().strip()
    return out


def parse(data: bytes, where: str) -> dict:
    """One record, checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive(f"{where}: no WARC version line")
    fields = _headers(lines, where)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if k not in fields]:
        raise BadArchive(f"{where}: lacks {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: Content-Length {fields['content-length']} with {len(rest) - 4} bytes")
    block = rest[:-4]
    if fields.get("warc-block-digest", f"sha1:{digest_of(block)}") != f"sha1:{digest_of(block)}":
        raise BadArchive(f"{where}: block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = _headers(http.partition(b"\r\n")[2], where).get("content-length", "")
    if not sep or not length.isdigit():
        raise BadArchive(f"{where}: no HTTP head with a length")
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(length) or digest_of(payload) != said):
        raise BadArchive(f"{where}: payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise BadArchive(f"{where}: revisit with a payload or without a referred record")
    if kind not in ("response", "revisit"):
        raise BadArchive(f"{where}: type {kind!r}")
    return {"page_id": _page_id(fields["warc-record-id"], where), "url": fields.get("warc-target-uri"), "payload_bytes": int(length), "payload_digest": said, "record_type": kind, "refers_to": _page_id(fields["warc-refers-to"], where) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


class Writer:
    def __init__(self, out, dictionary: bytes):
        import zstandard

        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
        held = packed if len(packed) < len(dictionary) else dictionary
        out.write(struct.pack("<II", MAGIC, len(held)) + held)
        found = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **found)

    def add(self, data: bytes) -> None:
        self.out.write(self.zstd.compress(data))


def read_archive(data: bytes, name: str) -> Iterator[dict]:
    """Every record of an archive's bytes, one frame each."""
    import zstandard

    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != MAGIC:
        raise BadArchive(f"{name}: no leading dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    held = data[8 : 8 + size]
    if len(held) != size:
        raise BadArchive(f"{name}: the dictionary frame is cut off")
    if held[:4] == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    zstd = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(held)} if held else {}))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        where = f"{name} at byte {at}"
        if data[at : at + 4] != FRAME:
            raise BadArchive(f"{where}: no frame")
        try:
            wanted = zstandard.frame_content_size(view[at : at + 18])
            step = zstd.decompressobj()
            # fed in pieces, so that a frame's end is found without reading the archive's rest for each record
            found, pos = io.BytesIO(), at
            while not step.eof and pos < len(data):
                found.write(step.decompress(view[pos : pos + 65536]))
                pos += 65536
            end = min(pos, len(data)) - len(step.unused_data)
        except zstandard.ZstdError as e:
            raise BadArchive(f"{where}: {e}") from e
        record_bytes = found.getvalue()
        if not step.eof or wanted not in (-1, len(record_bytes)):
            raise BadArchive(f"{where}: frame is cut off or has another size than it says")
        yield parse(record_bytes, where)
        at = end


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha (its SHA-1), last (largest page_id of equal payloads, null if it has none to share with)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    shared = stash(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1").select(F.col("sha").alias("_sha"), "last"), "shared")
    return rows.join(shared, F.col("sha") == F.col("_sha"), "left").drop("_sha")


def dictionary_of(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample: SAMPLE pages of least digest, SAMPLE_CHARS of each; none if they are too
    few. Digests alone are ranked; then only the sample's texts are read out."""
    import zstandard

    drawn = pages.where("html IS NOT NULL").select(F.xxhash64("page_id", "html").alias("k"))
    keys = [r.k for r in drawn.orderBy("k").limit(SAMPLE).collect()]
    rows = pages.where("html IS NOT NULL").where(F.xxhash64("page_id", "html").isin(keys)).select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).limit(SAMPLE).collect() if keys else []
    samples = sorted(r.h.encode() for r in rows if r.h)
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # too little in common: archives then have an empty dictionary frame


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row as a record; returns archive, records, bytes for each archive."""
    dictionary = dictionary_of(pages)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        out, made = io.BytesIO(), []
        writer, records = Writer(out, dictionary), 0

        def close() -> None:
            nonlocal out, writer, records
            if records:
                name = f"{uuid.uuid4().hex}.warc.zst"
                with store.open_output_stream(posixpath.join(base, name), compression=None) as to:
                    to.write(out.getbuffer())
                made.append((f"{folder}/{name}", records, out.tell()))
                out = io.BytesIO()
                writer, records = Writer(out, dictionary), 0

        for frame in frames:
            for page, url, payload, last in zip(frame["page_id"], frame["url"], frame["payload"], frame["last"]):
                page, last = (None if pd.isna(x) else int(x) for x in (page, last))
                writer.add(record(page, None if pd.isna(url) else url, bytes(payload), last, last is not None and page != last))
                records += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["archive", "records", "bytes"])

    # ids travel as text: pandas has no whole numbers with nulls
    rows = roles(pages).select(F.col("page_id").cast("string"), "url", "payload", F.col("last").cast("string"))
    return stash(rows.mapInPandas(write, "archive string, records long, bytes long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """RECORD rows of all archives of a manifest."""
    spark = manifest.sparkSession
    folders = [r[0] for r in manifest.select(F.regexp_extract("archive", "^(.*)/[^/]*$", 1)).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], RECORD)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                rows = [{k: v for k, v in r.items() if k in columns} | {"archive": name} for r in read_archive(bytes(content), name)]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(folders).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    wanted = manifest.select(F.regexp_extract("archive", "([^/]*)$", 1).alias("name"))
    return files.join(wanted, "name", "left_semi").mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of ``pages`` and returns what reading them gives."""
    return read_archives(write_archives(pages, folder or new_path(pages.sparkSession, "warc")))
