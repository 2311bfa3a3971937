"""WARC archives: writing, and a sequential reader.

An archive is a run of gzip members, one WARC record each.  The reader takes
the archive in small pieces, inflates member by member with an incremental
zlib object, frames each record by its Content-Length and verifies the digest
of the payload, so that its memory is that of one record whatever the size of
the archive.

Revisits: of pages with equal payloads of at least `REVISIT_BYTES`, that with
the smallest page id is stored, the others refer to it.

Defined cases: null payloads are empty; pages without an id are stored and never
referred to; repeated rows of the page that others refer to are stored each; a
very long payload is one record, held in memory once; other columns are ignored;
an empty table gives no archive and no record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

REVISIT_BYTES = 100
#: Payloads of more than this share of all pages are looked up by broadcast: there can't be more of them than its inverse.
HOT_SHARE, HOT_LEAST = 1 / 100_000, 1000
#: Bytes of one archive, and of what the reader inflates at once.
ARCHIVE_BYTES, PIECE = 8 << 20, 64 << 10

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page: str, uri: str, digest: str, length: int, payload: bytes, refers: str | None) -> bytes:
    """One record as a gzip member of its own."""
    clean = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + squeeze.flush()


class DigestError(ValueError):
    """A payload isn't the one that the record's header names."""


def _next(read: Callable[[int], bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn."""
    rest = read(PIECE)
    while rest:
        state = {"rest": rest}

        def pieces(state=state) -> Iterator[bytes]:
            inflate = zlib.decompressobj(31)
            data = state["rest"]
            while True:
                out = inflate.decompress(data, PIECE)
                if out:
                    yield out
                if inflate.eof:
                    state["rest"] = inflate.unused_data or read(PIECE)
                    return
                data = inflate.unconsumed_tail
                if not data and not (data := read(PIECE)):
                    raise ValueError("the archive ends within a record")

        member = pieces()
        yield member
        for _ in member:  # what the caller left
            pass
        rest = state["rest"]


def read_records(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, payload) of every record; `read(n)` gives up to n further bytes of the archive."""
    for member in _next(read):
        held = b""
        while (end := held.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise ValueError("a record without the end of its headers")
            held += piece
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        parts, have = [held[end + 4 :]], len(held) - end - 4
        digest = hashlib.sha256(parts[0][:length])
        while have < length + 4:
            piece = next(member, None)
            if piece is None:
                raise ValueError("a record is shorter than its Content-Length")
            digest.update(piece[: max(0, length - have)])
            parts.append(piece)
            have += len(piece)
        if have != length + 4 or b"".join(parts[-2:])[-4:] != b"\r\n\r\n" and b"".join(parts)[-4:] != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        if head["warc-type"] != "revisit" and f"sha256:{digest.hexdigest()}" != head.get("warc-payload-digest"):
            raise DigestError(head.get("warc-record-id", ""))
        yield head, b"".join(parts)[:length]


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page.

    A null payload counts as empty.  Pages without an id are always stored, as
    are repeated rows of the page that others refer to.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # digests that a second page shares; the sums before the shuffle keep hot payloads small
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").select(F.col("payload_digest").alias("d"), "first", "n")
    shared = materialize(shared, "shared")
    hot = max(HOT_LEAST, pages.count() * HOT_SHARE)
    often = shared.filter(F.col("n") >= hot).select(F.col("d").alias("hot_d"), F.col("first").alias("hot_first"))  # 1 / HOT_SHARE rows at most
    rows = rows.join(F.broadcast(often), F.col("payload_digest") == F.col("hot_d"), "left")
    # what has its answer, or none to look for, is spread over the tasks by a key that no digest equals
    spread = F.col("hot_d").isNotNull() | (F.col("payload_bytes") < least)
    key = F.when(spread, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest"))
    rows = rows.withColumn("k", key).join(shared.filter(F.col("n") < hot).select("d", "first"), F.col("k") == F.col("d"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    again = F.col("first") < F.col("page_id")
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame) -> DataFrame:
    """Archives of about ARCHIVE_BYTES each: one row (archive binary) per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    kind = r["record_type"]
                    page = "" if r["page_id"] is None else str(r["page_id"])
                    members.append(record(kind, page, r["url"] or "", r["payload_digest"], r["payload_bytes"], r["payload"] if kind == "response" else b"", r["refers_to"]))
                    size += len(members[-1])
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])
                        members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])

    return marked.mapInArrow(write, "archive binary")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """One row per record of the archives in a binary column (or of `content`, as Spark's binaryFile source gives them)."""

    def number(urn: str | None) -> int | None:
        found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for blob in b.column(0):
                if not blob.is_valid:
                    continue
                source = pa.BufferReader(blob.as_buffer())
                rows, size = [], 0
                for head, payload in read_records(source.read):
                    rows.append({"page_id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": head["warc-type"], "payload_bytes": int(head["x-payload-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"), "refers_to": number(head.get("warc-refers-to")), "payload": payload})
                    size += len(payload)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(column).mapInArrow(read, RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    from .common import table

    back = read_archives(write_archives(mark_revisits(table(spark, sf_dir, "pages"))))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
