"""Header rules of the archive reader, and the join of copies that isn't broadcast."""

import base64
import hashlib

import pytest

from tesserine.llm import shared, warc

DATE = "2020-02-29T23:59:60Z"


def record(block=b"text", **changes):
    headers = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": DATE, "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in changes.items()}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None)]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_names_have_any_case():
    headers, block = warc.parse_record(record(warc_Target_uri="http://x/").replace(b"WARC-Type", b"warc-type").replace(b"Content-Length", b"content-LENGTH"))
    assert headers["WARC-Type"] == "resource" and headers["WARC-Target-URI"] == "http://x/" and block == b"text"


@pytest.mark.parametrize("kind", ["sha1", "SHA1", "md5", "sha256", "sha-512"])
def test_digests(kind):
    raw = hashlib.new(kind.lower().replace("-", ""), b"text").digest()
    for digest in (base64.b32encode(raw).decode(), raw.hex()):
        assert warc.parse_record(record(WARC_Block_Digest=f"{kind}:{digest}"))
    with pytest.raises(warc.WarcError):
        warc.parse_record(record(WARC_Block_Digest=f"{kind}:{raw.hex()[::-1]}"))
    assert warc.parse_record(record(WARC_Block_Digest="blake3:unknown"))


@pytest.mark.parametrize(
    "changes",
    [{"WARC_Date": "junk"}, {"WARC_Date": "2020-13-01T00:00:00Z"}, {"WARC_Date": "2020-01-01T00:00:00"}, {"WARC_Date": None}, {"WARC_Type": "other"}, {"Content_Length": "٤"}, {"Content_Length": "-4"}, {"Content_Length": "5"}, {"WARC_Record_ID": "none"}, {"WARC_Block_Digest": "sha1"}, {"bad name": "x"}, {"warc_date": DATE}],
    ids=str,
)
def test_bad_headers(changes):
    with pytest.raises(warc.WarcError):
        warc.parse_record(record(**changes))


def test_http_length_and_dictionary():
    for length in ("٤", "9", "x"):
        with pytest.raises(warc.WarcError):
            warc.http_payload({"Content-Type": "application/http", "WARC-Type": "response"}, f"HTTP/1.1 200 OK\r\nContent-Length: {length}\r\n\r\nbody".encode())
    frame = warc.zstandard.ZstdCompressor().compress(record())
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(warc.archive_start(warc.zstandard.FRAME_HEADER + b"junk") + frame))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(frame[:6] + b"\xff" * 9 + frame[15:]))


def test_salted_join_of_copies(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"own {i}") for i in range(60)] + [(None, "u", "same")], "page_id long, url string, html string")
    want = sorted(map(str, warc.archived(pages).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.archived(pages).collect())) == want
