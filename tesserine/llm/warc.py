"""WARC/1.1 archives in Zstandard: a writer, and a reader that checks what it reads.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame per record. The reader loads the dictionary, finds each frame's end from its block
headers, decodes the frame as exactly one record, and validates version, headers, lengths,
digests and the record's end.

Archives are rows (archive, content) of a table, because executors of a cluster share no file
system that plain ``open()`` reaches. The reader takes any such table, so
``spark.read.format("binaryFile")`` of real ``.warc.zst`` files works too (path, content).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm import shared

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
#: Whole payloads of a task's first records, up to so many bytes, train the dictionary.
TRAINING_BYTES = 1 << 20
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_SPELLED = {h.lower(): h for h in (*_REQUIRED, "Content-Type", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Target-URI", "WARC-Profile", "WARC-Truncated", "WARC-Warcinfo-ID", "WARC-IP-Address")}
_DIGESTS = {"sha1", "sha-1", "md5", "sha256", "sha-256", "sha512", "sha-512"}
_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
#: A UTC date of a year at least, to the nanosecond at most.
_DATE = re.compile(r"\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d(:([0-5]\d|60)(\.\d{1,9})?)?Z)?)?)?", re.ASCII)
_TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, date: str, block: bytes, **headers: str | None) -> bytes:
    """One WARC record; header values are stripped of line ends, None leaves a header out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes | None:
    """A trained dictionary, or None where the samples are too few to train one."""
    if len(samples) < 8 or sum(map(len, samples)) < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def archive_start(dictionary: bytes | None) -> bytes:
    return b"" if dictionary is None else DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def frames(content: bytes) -> Iterator[tuple[bool, memoryview]]:
    """(skippable, frame or skippable data) of each Zstandard frame, found from the block headers."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if end > len(view) or at + 8 > len(view):
                raise WarcError("a skippable frame is cut off")
            yield True, view[at:end]
            at = end
            continue
        try:
            head = bytes(view[at : at + 18])
            end = at + zstandard.frame_header_size(head)
            checksum = zstandard.get_frame_parameters(head).has_checksum
        except zstandard.ZstdError as e:
            raise WarcError(f"no frame at byte {at}: {e}") from e
        last = False
        while not last:
            block = int.from_bytes(view[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
            if kind == 3 or end > len(view):
                raise WarcError("a frame is cut off or damaged")
        end += 4 * checksum
        if end > len(view):
            raise WarcError("a frame is cut off")
        yield False, view[at:end]
        at = end


def _length(value: str) -> int:
    if not value.isascii() or not value.isdigit():
        raise WarcError(f"not a length: {value[:40]!r}")
    return int(value)


def _check_digest(name: str, value: str, data: bytes) -> None:
    """Raise where a digest of a kind known here isn't that of the data; other kinds pass unchecked. SHA-1 may be base32 or hex."""
    kind, _, digest = value.partition(":")
    if not digest:
        raise WarcError(f"not a digest: {value[:80]!r}")
    if kind.lower() not in _DIGESTS:
        return
    raw = hashlib.new(kind.lower().replace("-", ""), data).digest()
    if digest.upper().rstrip("=") not in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper()):
        raise WarcError(f"{name} differs")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a frame that must hold exactly one valid record.

    Header names have any case and are returned as the standard spells them; a header of this
    standard may occur once, but for WARC-Concurrent-To, whose values are joined by blanks.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("headers aren't UTF-8") from e
    if not gap or lines[0].upper() not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("a frame doesn't start with a WARC header")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not _TOKEN.fullmatch(name):
            raise WarcError(f"not a header line: {line[:80]!r}")
        last = _SPELLED.get(name.lower(), name)
        if last in headers and last != "WARC-Concurrent-To":
            raise WarcError(f"{last} occurs twice")
        headers[last] = f"{headers[last]} {value.strip()}" if last in headers else value.strip()
    if missing := [h for h in _REQUIRED if h not in headers]:
        raise WarcError(f"headers are missing: {missing}")
    if headers["WARC-Type"] not in _TYPES:
        raise WarcError(f"unknown WARC-Type {headers['WARC-Type'][:40]!r}")
    if not _DATE.fullmatch(headers["WARC-Date"]):
        raise WarcError(f"not a date: {headers['WARC-Date'][:40]!r}")
    if not re.fullmatch(r"<?[A-Za-z][A-Za-z0-9+.-]*:\S+?>?", headers["WARC-Record-ID"]):
        raise WarcError(f"not a record id: {headers['WARC-Record-ID'][:80]!r}")
    length = _length(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the frame holds {len(rest) - 4}")
    block = rest[:length]
    if "WARC-Block-Digest" in headers:
        _check_digest("WARC-Block-Digest", headers["WARC-Block-Digest"], block)
    return headers, block


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive. Raises WarcError at the first breach of the format."""
    dictionary, decoder, first = None, None, True
    for skippable, frame in frames(content):
        if skippable:
            if first and int.from_bytes(frame[:4], "little") == DICTIONARY_MAGIC:
                raw = bytes(frame[8:])
                if raw[:4] == zstandard.FRAME_HEADER:  # the dictionary may itself be compressed
                    try:
                        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
                    except zstandard.ZstdError as e:
                        raise WarcError(f"the dictionary can't be decoded: {e}") from e
                dictionary = zstandard.ZstdCompressionDict(raw)
            first = False
            continue
        if decoder is None:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        first = False
        try:
            data = decoder.stream_reader(frame).read()
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield parse_record(data)


def http_payload(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP block, checked against its own Content-Length; any other block as it is."""
    if not headers.get("Content-Type", "").startswith("application/http"):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise WarcError("not an HTTP block")
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.lower() == "content-length" and _length(value.strip()) != len(body) and headers["WARC-Type"] != "revisit":
            raise WarcError("the HTTP length differs from the payload")
    return body


def _write(date: str):
    def encode(row: dict) -> bytes:
        payload = (row["html"] or "").encode()
        digest, revisit = f"sha1:{sha1_base32(payload)}", row["refers"] is not None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = http if revisit else http + payload
        return record(
            "revisit" if revisit else "response", f"urn:page:{row['page_id']}", date, block, WARC_Target_URI=row["url"], WARC_Payload_Digest=digest, WARC_Block_Digest=f"sha1:{sha1_base32(block)}",
            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None, WARC_Refers_To=f"<urn:page:{row['refers']}>" if revisit else None, Content_Type="application/http; msgtype=response",
        )

    def run(batches):
        dictionary, pack, buffer, waiting, ready, number = None, None, bytearray(), [], False, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal buffer
            if len(buffer) > len(archive_start(dictionary)):
                content = bytes(buffer)
                yield pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])
            buffer = bytearray(archive_start(dictionary))

        def put(data: bytes) -> Iterator[pa.RecordBatch]:
            buffer.extend(pack.compress(data))
            if len(buffer) >= ARCHIVE_BYTES:
                yield from close()

        def begin() -> Iterator[pa.RecordBatch]:
            nonlocal dictionary, pack, buffer, ready
            dictionary = dictionary_of(waiting)
            pack, buffer, ready = compressor(dictionary), bytearray(archive_start(dictionary)), True
            for data in waiting:
                yield from put(data)
            waiting.clear()

        for batch in batches:
            columns = {c: batch.column(c) for c in ("page_id", "url", "html", "refers")}
            for i in range(batch.num_rows):
                data = encode({c: v[i].as_py() for c, v in columns.items()})
                if ready:
                    yield from put(data)
                else:
                    waiting.append(data)
                    number += len(data)
                    if number >= TRAINING_BYTES:
                        yield from begin()
        if not ready and waiting:
            yield from begin()
        if ready:
            yield from close()

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, content) with one WARC record for each row of pages (page_id, url, html).

    Payload is the html in UTF-8, null: empty. Of rows with equal payloads of at least
    ``least_bytes`` bytes, the largest page_id is a response and the others revisit it; rows
    that share that page_id are responses too. All smaller payloads, and rows without a
    page_id, are responses. Null url: no target header.
    """
    pages = shared.pick(pages, "page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    groups = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).groupBy("digest")
    copies = groups.agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest")
    copies = shared.stage(copies, "copies")
    small = copies.count() <= shared.BROADCAST_ROWS // 4
    if not small:  # salted, as one payload may be that of a third of all pages
        salt = 32
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salt)))
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    marked = pages.join(F.broadcast(copies) if small else copies, ["digest"] if small else ["digest", "salt"], "left")
    marked = marked.select("page_id", "url", "html", F.expr("CASE WHEN page_id < newest THEN newest END").alias("refers"))
    return marked.mapInArrow(shared.trimmed(_write(date)), "archive string, content binary")


def _read(batches):
    for batch in batches:
        for content in batch.column("content").to_pylist():
            out: list[list] = [[], [], [], [], [], [], []]
            held = 0
            for headers, block in read_archive(content):
                payload = http_payload(headers, block)
                digest = headers.get("WARC-Payload-Digest") or None
                length = len(payload)
                if headers["WARC-Type"] == "revisit":
                    stated = next((x.partition(b":")[2] for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
                    length = _length(stated.decode("latin-1").strip())
                elif digest:
                    _check_digest("WARC-Payload-Digest", digest, payload)
                digest = digest and digest.removeprefix("sha1:")
                row = (headers["WARC-Record-ID"].strip("<>"), headers["WARC-Type"], headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To", "").strip("<>") or None, digest, length, payload if headers["WARC-Type"] != "revisit" else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                held += len(payload)
                if held > 4 << 20:
                    yield _records(out)
                    out, held = [[], [], [], [], [], [], []], 0
            yield _records(out)
    shared.release()


_RECORDS = (("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))


def _records(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, _RECORDS, strict=True)], [n for n, _ in _RECORDS])


def _digests(batches):
    for batch in _read(batches):
        yield batch.drop_columns(["payload"])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of a table with a binary column ``content`` of whole archives.

    Raises WarcError where an archive breaks the format. payload is null for a revisit; its
    payload_bytes and payload_digest are those of the full payload, from its headers.
    """
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
    source = archives.select(archives["content"])
    return source.mapInArrow(_read, schema + ", payload binary") if payloads else source.mapInArrow(_digests, schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and return one row per page."""
    shared.bounded_batches(pages.sparkSession)
    written = shared.stage(write_archives(pages, least_bytes), "warc", **{"parquet.block.size": 16 << 20, "compression": "none"})
    number = lambda c: F.expr(f"try_cast(substr({c}, {len('urn:page:') + 1}) AS long)")
    return read_archives(written, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
