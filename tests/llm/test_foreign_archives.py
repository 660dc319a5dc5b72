"""The reader takes archives that others wrote."""

import base64
import gzip
import hashlib
import io

import pytest

from linkweave.llm import warc


def member(head, block):
    return gzip.compress("\r\n".join(["WARC/1.0", *head, f"content-length:{len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def read(*members):
    return [(h, b"".join(p), f) for h, p, f in warc.records(io.BytesIO(b"".join(members)))]


def test_fields():
    assert warc.fields(["warc-type:  response ", "WARC-Target-URI:http://a/b:c", " /d", "X-Own : 1", "no field"]) == {"WARC-Type": "response", "WARC-Target-URI": "http://a/b:c /d", "X-Own": "1"}


def test_kinds_of_records():
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha = base64.b32encode(hashlib.sha1(b"page").digest()).decode()
    got = read(
        member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore"),
        member(["WARC-Type:response", f"warc-payload-digest:sha1:{sha}", "Content-Type: application/http;msgtype=response"], http + b"page"),
        member(["WARC-Type: response", f"WARC-Payload-Digest: SHA256:{hashlib.sha256(b'page').hexdigest()}", "Content-Type: Application/HTTP; msgtype=response"], http + b"page"),
        member(["WARC-Type: resource", "Content-Type: text/plain", f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'text').hexdigest()}"], b"text"),
        member(["WARC-Type: revisit", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"], http),
        member(["WARC-Type: request", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n"),
        member(["WARC-Type: metadata", "WARC-Payload-Digest: blake3:abc"], b""),
    )
    assert [x[1] for x in got] == [b"software: x\r\n\r\nmore", b"page", b"page", b"text", b"", b"", b""]
    assert [x[2]["bytes"] for x in got] == [19, 4, 4, 4, 0, 0, 0] and got[1][2]["sha1"] == hashlib.sha1(b"page").hexdigest()


def test_a_long_payload_in_chunks():
    body = bytes(range(256)) * 3000
    ((_, payload, facts),) = read(member(["WARC-Type: conversion"], body))
    assert payload == body and facts["bytes"] == len(body)


@pytest.mark.parametrize("digest", ["sha1:" + "0" * 40, "sha256:" + "A" * 52, "md5:00"])
def test_wrong_digests(digest):
    with pytest.raises(ValueError, match="digest"):
        read(member(["WARC-Type: resource", f"WARC-Payload-Digest: {digest}"], b"text"))
