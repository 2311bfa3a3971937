"""Media columns: TIFF pages.

`encode_tiff` stores bytes losslessly as the 8-bit samples of a grey image, in
strips or tiles, plain or compressed with PackBits, LZW or deflate, with or
without the horizontal predictor.  `read_pages` walks the image directories of
either byte order, decodes strips and tiles, undoes the predictor and gives one
page after the other.  `tiff_pages` is that reader over a binary column: one
row per page.

A page's samples are decoded one strip or tile at a time; the memory is that of
one page.  Rows are independent, so nothing is shuffled.

Defined cases: null media give no row; of media that cannot be read, the pages
before the damage are given and then a row with page -1 and the reason.  No
size that a file states is believed before it is checked against the file: tags
must lie in it, a page must have exactly the strips or tiles that cover it, and
none may be larger than its codec could have made it.  Null and empty texts are
stored as one row of zeros; a very long text is several pages; repeated rows
have equal results; columns not kept are ignored, kept ones may have any name
but those of the result; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_OLD_DEFLATE = 32946
#: Bytes of a field type of the format, by its number.
_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
ROW = 64


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes or more as run packets, all else as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    out = bytearray()

    def literal(i: int, j: int) -> None:
        for k in range(i, j, 128):
            part = data[k : min(k + 128, j)]
            out.append(len(part) - 1)
            out.extend(part)

    if len(a) == 0:
        return b""
    edge = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1, [len(a)]))
    long = np.flatnonzero(np.diff(edge) >= 3)
    at = 0
    for i, j in zip(edge[long].tolist(), edge[long + 1].tolist()):
        literal(at, i)
        for k in range(i, j, 128):
            n = min(128, j - k)
            out.append(257 - n if n > 1 else 0)
            out.append(data[k])
        at = j
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, 0
    while n < size and i < len(data):
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + k + 2])
            i, n = i + k + 2, n + k + 1
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i, n = i + 2, n + 257 - k
        else:
            i += 1
    return b"".join(out)[:size]


_SINGLE = [bytes((i,)) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the table is cleared before it is full."""
    codes, widths = [256], [9]
    table = {s: i for i, s in enumerate(_SINGLE)}
    width, free, word = 9, 258, b""
    for c in map(_SINGLE.__getitem__, data):
        longer = word + c
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        widths.append(width)
        table[longer] = free
        free += 1
        word = c
        if free == 4095:
            codes.append(256)
            widths.append(width)
            table = {s: i for i, s in enumerate(_SINGLE)}
            width, free = 9, 258
        elif free > (1 << width) - 1:
            width += 1
    if word:
        codes.append(table[word])
        widths.append(width)
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    return _pack(np.array(codes, np.uint32), np.array(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    shift = np.arange(11, -1, -1)
    bits = ((codes[:, None] >> shift) & 1).astype(np.uint8)
    return np.packbits(bits[shift < widths[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    base = [*_SINGLE, b"", b""]
    table, width, n, last = base.copy(), 9, 0, b""
    held, bits, i = 0, 0, 0
    while n < size:
        while bits < width:
            if i >= len(data):
                return b"".join(out)
            held = (held << 8 | data[i]) & 0xFFFFFFFF
            bits, i = bits + 8, i + 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 256:
            table, width, last = base.copy(), 9, b""
            continue
        if code == 257:
            break
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        n += len(word)
        last = word
    return b"".join(out)[:size]


def _compress(kind: int, data: bytes) -> bytes:
    if kind == PACKBITS:
        return packbits_encode(data)
    if kind == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1) if kind == DEFLATE else data


def _expand(kind: int, data: bytes, size: int) -> bytes:
    if kind == PACKBITS:
        return packbits_decode(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, _OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if kind == NONE:
        return data[:size]
    raise ValueError(f"compression {kind} is not supported")


def encode_tiff(pages: list[bytes], kind: int = DEFLATE, predictor: bool = False, tiled: bool = False, width: int = ROW, strip_rows: int = 1024, big: bool = False) -> bytes:
    """One page per item; an item's length must be a positive multiple of `width`.

    Tiles are `width` by 64 samples wide and high, the last one padded.
    """
    e = ">" if big else "<"
    out = bytearray(struct.pack(e + "2sHI", b"MM" if big else b"II", 42, 8))
    for p, page in enumerate(pages):
        height, rest = divmod(len(page), width)
        if rest or not height:
            raise ValueError("a page is a positive number of whole rows")
        image = np.frombuffer(page, np.uint8).reshape(height, width)
        rows = 64 if tiled else strip_rows
        parts = []
        for r in range(0, height, rows):
            part = image[r : r + rows]
            if tiled and len(part) < rows:
                part = np.concatenate((part, np.zeros((rows - len(part), width), np.uint8)))
            if predictor:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)
            parts.append(_compress(kind, part.tobytes()))
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [kind]), (262, 3, [1]), (277, 3, [1]), (317, 3, [2 if predictor else 1])]
        tags += [(322, 4, [width]), (323, 4, [rows]), (324, 4, None), (325, 4, [len(x) for x in parts])] if tiled else [(273, 4, None), (278, 4, [rows]), (279, 4, [len(x) for x in parts])]
        tags.sort()
        here, n = len(out), len(parts)
        extra = here + 2 + 12 * len(tags) + 4
        data_at = extra + (8 * n if n > 1 else 0)
        starts = np.cumsum([data_at, *(len(x) for x in parts)])[:-1].tolist()
        out += struct.pack(e + "H", len(tags))
        tail = bytearray()
        for tag, kind_of, values in tags:
            values = starts if values is None else values
            raw = struct.pack(e + ("H" if kind_of == 3 else "I") * len(values), *values)
            if len(raw) > 4:
                at = extra + len(tail)
                tail += raw
                raw = struct.pack(e + "I", at)
            out += struct.pack(e + "HHI", tag, kind_of, len(values)) + raw.ljust(4, b"\0")
        end = data_at + sum(map(len, parts))
        out += struct.pack(e + "I", end + end % 2 if p + 1 < len(pages) else 0)
        out += tail
        for x in parts:
            out += x
        if p + 1 < len(pages) and len(out) % 2:
            out.append(0)
    return bytes(out)


def read_pages(media: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    """(tags, samples as rows by columns) of every image directory."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", media, at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            where = at + 2 + 12 * k + 8
            if _WIDTH.get(kind, 1) * count > 4:
                where = struct.unpack_from(order + "I", media, where)[0]
            letter = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}.get(kind)
            if letter and where + _WIDTH[kind] * count > len(media):
                raise ValueError(f"tag {tag} reaches beyond the file")
            if letter:
                tags[tag] = list(struct.unpack_from(order + letter * count, media, where))
        yield tags, _samples(media, tags)
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


#: The most bytes that a byte of a codec's data can become.
_GROWTH = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, _OLD_DEFLATE: 1032, LZW: 4096}


def _samples(media: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, least: tags.get(tag, [least])[0]
    width, height, kind = tags[256][0], tags[257][0], one(259, NONE)
    if one(277, 1) != 1 or one(258, 8) != 8:
        raise ValueError("only one 8-bit sample per pixel is supported")
    if kind not in _GROWTH or one(317, 1) not in (1, 2):
        raise ValueError(f"compression {kind} with predictor {one(317, 1)} is not supported")
    undo = one(317, 1) == 2
    tile = tags.get(322)
    across, rows = (tile[0], tags[323][0]) if tile else (width, min(one(278, height), height))
    if min(width, height, across, rows) < 1:
        raise ValueError("a page, strip or tile without samples")
    per_row = -(-width // across)
    parts = per_row * -(-height // rows)
    starts, sizes = tags[324 if tile else 273], tags[325 if tile else 279]
    if len(starts) != parts or len(sizes) != parts:
        raise ValueError(f"{len(starts)} and {len(sizes)} entries for {parts} strips or tiles")
    high = lambda r: rows if tile else min(rows, height - r)
    for k, (start, n) in enumerate(zip(starts, sizes)):
        if start + n > len(media) or high(k // per_row * rows) * across > n * _GROWTH[kind] + 4096:
            raise ValueError(f"part {k} is beyond the file or too small for its samples")
    image = np.empty((height, width), np.uint8)
    for k, (start, n) in enumerate(zip(starts, sizes)):
        r, c = k // per_row * rows, k % per_row * across
        have = high(r)
        raw = _expand(kind, media[start : start + n], have * across)
        if len(raw) != have * across:
            raise ValueError(f"part {k} is short")
        part = np.frombuffer(raw, np.uint8).reshape(have, across)
        if undo:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        h, w = min(have, height - r), min(across, width - c)
        image[r : r + h, c : c + w] = part[:h, :w]
    return image


def average_hash(image: np.ndarray) -> str:
    """8 x 8 means of the image against their own mean, as 16 hex digits, and the mean sample."""
    h, w = image.shape
    rows = np.add.reduceat(image.astype(np.int64).sum(axis=1) if w < 8 else image.reshape(h, -1).astype(np.int64), np.minimum(np.arange(8) * h // 8, h - 1), axis=0)
    if w >= 8:
        rows = np.add.reduceat(rows, np.arange(8) * w // 8, axis=1)
    bits = (rows.reshape(-1) > rows.mean()).astype(np.uint8)
    return f"{np.packbits(bits).tobytes().hex()}-{int(image.sum(dtype=np.int64)) * 1000 // image.size}"


PAGES = "page int, width int, height int, compression int, n_bytes long, sha256 string, tail_crc32 long, feature string, last boolean, so_far_bytes long, so_far_sha256 string, so_far_feature string, error string"
_PAGE_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _page_rows(media: bytes, tail: int) -> list[tuple]:
    rows: list[tuple] = []
    size, total, whole, mark = 0, 0, hashlib.sha256(), ""
    try:
        for p, (tags, image) in enumerate(read_pages(media)):
            raw, feature = image.tobytes(), average_hash(image)
            whole.update(raw)
            size, total, mark = size + len(raw), total + int(image.sum(dtype=np.int64)), mark or feature.partition("-")[0]
            rows.append((p, image.shape[1], image.shape[0], tags.get(259, [NONE])[0], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-tail:]), feature, False, size, whole.copy().hexdigest(), f"{mark}-{total * 1000 // size}", None))
        if rows:
            rows[-1] = (*rows[-1][:8], True, *rows[-1][9:])
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as bad:
        rows.append((-1, *[None] * 11, f"{type(bad).__name__}: {bad}"))
    return rows


def tiff_pages(df: DataFrame, media: str, keep: tuple[str, ...], tail: int = ROW) -> DataFrame:
    """One row per page: the `keep` columns, size, digest and features of the decoded samples.

    `so_far_...` is the same of this page and all before it in the file; `last`
    marks the last page of a file that could be read to its end.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took: list[int] = []
            rows: list[tuple] = []
            for i, m in enumerate(b.column(b.num_columns - 1)):
                if m.is_valid:
                    found = _page_rows(m.as_py(), tail)
                    took += [i] * len(found)
                    rows += found
            kept = [c.take(pa.array(took, pa.int64())) for c in b.columns[:-1]]
            columns = zip(*rows) if rows else [()] * len(_PAGE_KINDS)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, k) for v, k in zip(columns, _PAGE_KINDS))], names=[*b.schema.names[:-1], *(x.split()[0] for x in PAGES.split(", "))])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return df.select(*keep, F.col(media).alias(unused(keep, "_media")[0])).mapInArrow(decode, ", ".join([*kept, PAGES]))


#: How the stored form is made, dealt evenly by crc32 of the payload: (compression, predictor, tiled, big-endian).
FORMS = [(kind, predictor, tiled, big) for kind in (NONE, PACKBITS, LZW, DEFLATE) for predictor in (False, True) for tiled in (False, True) for big in (False, True)]
#: Bytes of a page; a longer payload has several.
PAGE_BYTES = 64 << 10


def text_to_tiff(df: DataFrame, text: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, the text's bytes counted, and a TIFF that holds them in pages, padded with zeros to rows of 64.

    Null texts count as empty; an empty text is one row of zeros.  Equal texts
    get equal media, whatever else is in their rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            for i in range(0, len(column), 256):
                sizes, media = [], []
                for t in column.slice(i, 256).cast(pa.large_string()).to_pylist():
                    raw = (t or "").encode()
                    payload = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")
                    kind, predictor, tiled, big = FORMS[zlib.crc32(payload) % len(FORMS)]
                    pages = [payload[k : k + PAGE_BYTES] for k in range(0, len(payload), PAGE_BYTES)]
                    sizes.append(len(raw))
                    media.append(encode_tiff(pages, kind, predictor, tiled, big=big))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 256) for c in b.columns[:-1]), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*b.schema.names[:-1], "n_text", "media"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return df.select(*keep, F.col(text).alias(unused(keep, "_text")[0])).mapInArrow(encode, ", ".join([*kept, "n_text long, media binary"]))


def op1_media_tiff(spark, sf_dir: str) -> DataFrame:
    """Every whole document stored as the pages of a TIFF and read back: one row per document, that of its last page."""
    from .common import table

    stored = text_to_tiff(table(spark, sf_dir, "documents"), "text").select("doc_id", "n_text", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(stored, "media", ("doc_id", "n_text", "media_bytes", "media_sha256")).filter("last or page < 0")
    return pages.select("doc_id", F.col("n_text").alias("n_bytes"), F.col("so_far_bytes").alias("payload_bytes"), F.col("so_far_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", F.col("so_far_feature").alias("feature"), "page", "compression")
