"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where no piece of the vocabulary can reach across: in front of
a run of spaces, after any other character.  That is safe when no piece has a
space mark behind another character, which is checked on the vocabulary.  The
splits bound the length of what is encoded at once, and since equal units have
equal lengths, each distinct unit of a byte-balanced block is encoded once.  A
text without spaces has no safe place and is one unit, however long.

Defined cases: null and empty texts have no tokens; repeated rows have equal
results; other columns are ignored, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .textkernel import row_blocks, text_buffers

#: Bytes of text in one call to the encoder.
BLOCK_BYTES = 4 << 20
#: Units remembered by a worker between blocks; then it starts anew.
REMEMBERED = 400_000

_UNIT = re.compile(" *[^ ]+| +")
_MARK = "▁"
_loaded: dict[str, tuple] = {}


def _units(text: str) -> list[str]:
    """The text cut before every run of spaces, each unit without the one space that the encoder adds by itself."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    units = _UNIT.findall(text)
    return [units[0], *(u[1:] for u in units[1:])]


def _unit_lengths(model, units: list[str]) -> list[int]:
    """Pieces of each unit; the unit without characters is a last single space."""
    return [len(x) if u else 1 for u, x in zip(units, model.encode(units, num_threads=1))]


def _piece_model(path: str):
    """(encoder, whether splitting before spaces is safe, memory of units)."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        reaching = any(_MARK in p.lstrip(_MARK) for p in map(model.id_to_piece, range(model.get_piece_size())))
        # the dummy prefix and untouched runs of spaces are what makes a unit's encoding independent of its place
        probe = ["a b", "a  b ", " ab cd   ef  "]
        same = all(len(model.encode(t)) == sum(_unit_lengths(model, _units(t))) for t in probe)
        _loaded[path] = model, same and not reaching, {}
    return _loaded[path]


def piece_lengths(texts: list[str], path: str) -> np.ndarray:
    """Number of pieces of every text, as the library's encode gives them."""
    model, safe, memory = _piece_model(path)
    if not safe:
        return np.array([len(x) for x in model.encode(texts, num_threads=1)], dtype=np.int64)
    split = [_units(t) for t in texts]
    seen = set().union(*split)
    new = [u for u in seen if u not in memory]
    if len(memory) + len(new) > REMEMBERED:
        memory.clear()
        new = list(seen)
    memory.update(zip(new, _unit_lengths(model, new)))
    get = memory.__getitem__
    return np.fromiter((sum(map(get, units)) for units in split), dtype=np.int64, count=len(texts))


def token_counts(df: DataFrame, text: str, path: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_bytes, n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens.  Rows are independent:
    repeated rows repeat their result, no shuffle happens, and a lost task is
    simply run again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            offsets, _ = text_buffers(column)
            counts = [np.zeros(0, np.int64)]
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                counts.append(piece_lengths([x or "" for x in column.slice(i, j - i).to_pylist()], path))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[*b.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return df.select(*keep, F.col(text).alias(unused(keep, "_text")[0])).mapInArrow(count, ", ".join([*kept, "n_bytes long, n_tokens long, over_limit boolean"]))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Pieces of every whole document under piece_bpe_32k.model."""
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("piece_bpe_32k.model"))
