"""Alignments of BAM files, read in plain Python.

A file is a run of gzip members (blocks of up to 64 KB), inflated one after the
other; records are cut from what is inflated and go on in batches.  A file is
one task, whose memory is that of the file (Spark's binaryFile rows, 2 GB at
most) and one batch; larger files have to be split by chromosome beforehand.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import CALLS, CONTEXT, decode_mm, keep_reads

ALIGNMENTS = "read_id string, flag int, chrom string, start int, mapq int, strand string, sequence string, quals string, positions array<int>, xm string, xg string, mm string, ml array<int>, sample string"
BATCH = 4096
_BASES, _NUMBER = "=ACMGRSVTWYHKDBN", {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of a run of gzip members, in pieces."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("the file ends within a block")
            part = view[at : at + piece]
            out = member.decompress(part)
            at += len(part) - len(member.unused_data)
            if out:
                yield out


class _Source:
    def __init__(self, data: bytes) -> None:
        self.pieces, self.held = inflated(data), b""

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end."""
        parts, have = [self.held], len(self.held)
        while have < n:
            piece = next(self.pieces, None)
            if piece is None:
                break
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _tags(raw: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind == "B":
            code, n = _NUMBER[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)[0]
            out[name] = list(struct.unpack_from(f"<{n}{code}", raw, at + 5))
            at += 5 + n * struct.calcsize(code)
        else:
            code = _NUMBER[kind]
            out[name], at = struct.unpack_from("<" + code, raw, at)[0], at + struct.calcsize(code)
    return out


def _positions(start: int, cigar: tuple[int, ...]) -> list[int | None]:
    """The reference position of each base of the read; none for inserted and clipped ones."""
    out: list[int | None] = []
    for c in cigar:
        n, op = c >> 4, "MIDNSHP=X"[c & 15]
        if op in "M=X":
            out.extend(range(start, start + n))
            start += n
        elif op in "IS":
            out.extend([None] * n)
        elif op in "DN":
            start += n
    return out


def records(data: bytes) -> Iterator[dict]:
    """Every alignment of a file, as a row of ALIGNMENTS without the sample."""
    source = _Source(data)
    if source.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    source.take(source.number())
    names = []
    for _ in range(source.number()):
        names.append(source.take(source.number())[:-1].decode())
        source.number()
    while size := source.take(4):
        raw = source.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw)
        at = 32 + l_name
        cigar = struct.unpack_from(f"<{n_cigar}I", raw, at)
        at += 4 * n_cigar
        half = raw[at : at + (l_seq + 1) // 2]
        at += len(half)
        quals = raw[at : at + l_seq]
        tags = _tags(raw[at + l_seq :])
        yield {
            "read_id": raw[32 : 32 + l_name - 1].decode(),
            "flag": flag,
            "chrom": names[ref] if ref >= 0 else None,
            "start": pos,
            "mapq": mapq,
            "strand": "-" if flag & 16 else "+",
            "sequence": "".join(_BASES[b >> 4] + _BASES[b & 15] for b in half)[:l_seq],
            "quals": "".join(chr(33 + (0 if q == 255 else q)) for q in quals),
            "positions": _positions(pos, cigar),
            "xm": tags.get("XM"),
            "xg": tags.get("XG"),
            "mm": tags.get("MM", tags.get("Mm")),
            "ml": tags.get("ML", tags.get("Ml")),
        }


def read_bam(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """The alignments of all samples (sample_id, path); a file is known by its whole path."""
    from .readers import _by_sample, _samples_of

    paths, keyed = _samples_of(spark, obs)
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (x.split() for x in ALIGNMENTS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sample, data in zip(b.column(0), b.column(1)):
                rows = []
                for r in records(data.as_py()):
                    rows.append(r | {"sample": sample.as_py()})
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_file"), "content")
    return _by_sample(files, keyed).select("sample", "content").mapInArrow(read, ALIGNMENTS)


def calls(alignments: DataFrame, caller: str = "bismark", context: str = "CpG", min_mapq: int = 10, min_baseq: int = 20, regions: DataFrame | None = None) -> DataFrame:
    """One row per call of the reads that count; with regions (chrom, start, end) only calls inside, once for each region."""
    if caller not in ("bismark", "methyldackel"):
        raise ValueError("the caller is bismark or methyldackel")
    kept = keep_reads(alignments, min_mapq)
    if caller == "bismark":
        letters = "".join(CONTEXT.values()) if context == "any" else CONTEXT[context]
        among = ", ".join(f"'{x}'" for x in letters)
        found = F.expr(f"filter(transform(sequence(1, length(xm)), i -> struct(positions[i - 1] as pos, substring(xm, i, 1) as l, ascii(substring(quals, i, 1)) - 33 as q)), c -> c.l in ({among}) and c.q >= {min_baseq} and c.pos is not null)")
        rows = kept.filter("xm is not null and length(xm) > 0").withColumn("c", F.explode(found))
        out = rows.select("read_id", "chrom", F.col("c.pos").alias("pos"), F.expr("c.l = upper(c.l)").cast("byte").alias("methylation_status"), F.col("c.q").cast("byte").alias("base_qual"), F.col("mapq").cast("byte").alias("mapq"), "strand", "sample")
    else:

        def decode(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    for off, m in decode_mm(r.sequence, r.mm, list(r.ml), r.strand == "-"):
                        at, q = r.positions[off], ord(r.quals[off]) - 33
                        if at is not None and at == at and q >= min_baseq:
                            rows.append((r.read_id, r.chrom, int(at), m, q, r.mapq, r.strand, r.sample))
                yield pd.DataFrame(rows, columns=["read_id", "chrom", "pos", "methylation_status", "base_qual", "mapq", "strand", "sample"])

        out = kept.filter("mm is not null and ml is not null").mapInPandas(decode, CALLS + ", sample string")
    if regions is None:
        return out
    from ..operators.intervals import points_in

    return points_in(out, regions.select("chrom", "start", "end")).select(out.columns)


def bases_at(alignments: DataFrame, snvs: DataFrame, min_mapq: int = 10, min_baseq: int = 20) -> DataFrame:
    """(sample, read_id, chrom, pos, base, strand) of the reads' bases at given positions; the strand is that of the conversion, by the XG tag."""
    at = F.explode(F.expr("filter(transform(sequence(1, length(sequence)), i -> struct(positions[i - 1] as pos, substring(sequence, i, 1) as base, ascii(substring(quals, i, 1)) - 33 as q)), c -> c.pos is not null and c.q >= " + str(min_baseq) + ")"))
    rows = keep_reads(alignments, min_mapq).select("sample", "read_id", "chrom", F.when(F.col("xg") == "GA", "-").when(F.col("xg") == "CT", "+").otherwise(F.col("strand")).alias("strand"), at.alias("c"))
    rows = rows.select("sample", "read_id", "chrom", F.col("c.pos").alias("pos"), F.col("c.base").alias("base"), "strand")
    return rows.join(snvs.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi").select("sample", "read_id", "chrom", "pos", "base", "strand")
