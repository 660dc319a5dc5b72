"""WARC archives: one gzip member a record, payload-digest revisits, a sequential verifying reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import bounded_batches, fresh, stored

#: Payloads of fewer bytes are stored again rather than revisited.
LEAST = 1000
CHUNK = 1 << 16
_NAME = "urn:linkweave:page:"
#: Names of header fields, by their lower case.
_FIELDS = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type", "Content-Length", "X-Payload-Length")}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. payload None: a revisit of the record of page ``refers_to``."""
    name = "" if page_id is None else page_id
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    kind = "revisit" if payload is None else "response"
    block = b"" if payload is None else _HTTP % size + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_NAME}{name}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <{_NAME}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Member:
    """The bytes of one gzip member, inflated bit by bit."""

    def __init__(self, src: BinaryIO, held: bytes):
        self.src, self.raw, self.z, self.out = src, held, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate up to a chunk; False at the member's end."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw or self.src.read(CHUNK)
        self.raw = b""
        if not data:
            raise ValueError("the archive ends within a record")
        self.out += self.z.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before a mark, which is used up; None if the mark does not end within the next ``most`` bytes."""
        while (i := self.out.find(mark)) < 0:
            if most is not None and len(self.out) >= most:
                return None
            if not self.more():
                raise ValueError("a record has no end of header")
        if most is not None and i + len(mark) > most:
            return None
        head, self.out = self.out[:i], self.out[i + len(mark) :]
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise ValueError("a record is shorter than its content length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            if part:
                yield part

    def left(self) -> bytes:
        while self.more():
            if len(self.out) > CHUNK:
                raise ValueError("a record is longer than its content length")
        return self.z.unused_data


def fields(lines: list[str]) -> dict[str, str]:
    """Header fields by name. Names count in any case and are given as the standard writes them; space around values goes, and a line that begins with space continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = _FIELDS.get(name.strip().lower(), name.strip())
            out[last] = value.strip()
    return out


def digest_matches(want: str | None, sums: dict) -> bool:
    """Whether a digest field, in base 32 or hexadecimal, is that of one of the sums by algorithm. A missing one, or one of another algorithm, is not held against anything."""
    kind, _, value = (want or "").partition(":")
    if kind.lower() not in sums:
        return True
    h = sums[kind.lower()]
    return value.strip().lower() in (h.hexdigest(), base64.b32encode(h.digest()).decode().lower(), base64.b32encode(h.digest()).decode().rstrip("=").lower())


def records(src: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes], dict]]:
    """(header, payload parts, facts) one after the other, holding a chunk at a time.

    The payload is what follows the header of an HTTP message, and the whole
    block of records that hold none (of the archive itself, of resources,
    metadata and conversions); an HTTP header without an end has no payload.
    Once the parts are used up, facts has ``bytes`` and ``sha1`` of the
    payload; a digest other than the header's is an error, but for revisits,
    which don't hold what it is of, as are short or overlong records. Parts
    that the caller leaves are read and verified.
    """
    held = src.read(CHUNK)
    while held:
        m = _Member(src, held)
        first, *lines = m.until(b"\r\n\r\n").decode(errors="replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = fields(lines)
        facts: dict = {}

        def payload(m=m, head=head, facts=facts) -> Iterator[bytes]:
            length, sha, size = int(head["Content-Length"]), hashlib.sha1(), 0
            want = None if head.get("WARC-Type", "").lower() == "revisit" else head.get("WARC-Payload-Digest")
            sums = {"sha1": sha} | {k: hashlib.new(k) for k in ("md5", "sha256") if (want or "").lower().startswith(k + ":")}
            hidden = False
            if length and head.get("Content-Type", "").lower().startswith("application/http"):
                http = m.until(b"\r\n\r\n", length)
                hidden = http is None
                length -= 0 if hidden else len(http) + 4
            for part in m.exactly(length):
                if not hidden:
                    for h in sums.values():
                        h.update(part)
                    size += len(part)
                    yield part
            if not hidden and not digest_matches(want, sums):
                raise ValueError(f"digest of {head.get('WARC-Record-ID')} is {sha.hexdigest()}, not {want}")
            facts.update(bytes=size, sha1=sha.hexdigest())

        parts = payload()
        yield head, parts, facts
        for _ in parts:
            pass
        if b"".join(m.exactly(4)) != b"\r\n\r\n":
            raise ValueError("a record's end is not marked")
        held = m.left()
        held = held or src.read(CHUNK)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); returns the manifest (path, records).

    Null html is an empty payload. Of equal payloads of at least ``least``
    bytes the largest page_id responds (rows that repeat it too; null ids only
    if there is no other), the others revisit. The digests' maxima are combined
    before the shuffle; the join on the digest is a plain one, whose hot keys
    adaptive execution splits.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or fresh(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"size": F.length("payload"), "digest": F.sha1("payload")})
    keepers = p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null").select("digest", "keeper")
    j = p.join(keepers, "digest", "left")
    revisits = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")))
    j = j.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest", "size", F.when(revisits, F.col("keeper")).alias("refers_to"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, n = None, None, 0
        for b in batches:
            for i, url, payload, digest, size, to in b.itertuples(index=False):
                if out is None:
                    path = files.attempt(folder, f"part-{TaskContext.get().partitionId():06d}") + ".warc.gz"
                    fs, local = files.opened(path)
                    out = fs.open_output_stream(local, compression=None)
                out.write(record(None if pd.isna(i) else int(i), url, payload, digest, size, None if pd.isna(to) else int(to)))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return stored(j.mapInPandas(archive, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, digests verified."""
    number = lambda s: int(x) if (x := s.removeprefix(f"<{_NAME}").removesuffix(">")) else None

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                fs, local = files.opened(path)
                rows = []
                with fs.open_input_stream(local, compression=None) as src:
                    for head, parts, facts in records(src):
                        for _ in parts:
                            pass
                        again = head["WARC-Type"] == "revisit"
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]) if again else facts["bytes"], digest if again else facts["sha1"], head["WARC-Type"], number(head["WARC-Refers-To"]) if again else None))
                f = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield f.assign(page_id=pd.array(f["page_id"].tolist(), dtype="Int64"), refers_to=pd.array([None if pd.isna(x) else int(x) for x in f["refers_to"]], dtype="Int64"))

    n = manifest.count()
    return manifest.select("path").repartition(max(1, n)).mapInPandas(parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
