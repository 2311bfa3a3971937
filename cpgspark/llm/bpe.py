"""BPE encoding and decoding with a pair occurrence index.

All distinct new words of a block are laid out in one array of symbols, linked
as lists.  An index maps every adjacent pair that has a rank to all its
positions; the ranks that are active wait in a heap.  Ranks are taken in
ascending order, each merging all its positions at once, and every merge
appends the pairs that it begins to the lists of their ranks; positions whose
pair another merge has ended are passed over.  Since a merge only begins pairs
of later rank, one pass over the ranks encodes the block.

Around that, the steps of the tokenizer file: added tokens are cut out first,
then each stretch is normalised, split into words and mapped to byte symbols,
the last of a word with the end mark.  Texts of characters below U+0300, which
no normalisation joins, are split by one pattern; others go by the library's
own normaliser and split, for each distinct piece between ASCII white space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .textkernel import give_back, row_blocks, text_buffers

BLOCK_BYTES = 2 << 20
#: Words and pieces remembered by a worker between blocks; then it starts anew, as with each task.
REMEMBERED = 80_000

_GAP = re.compile("[ \t\r\n]+")
_HIGH = re.compile("[\u0300-\U0010ffff]")
#: The word pattern of the tokenizer file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _low_words() -> re.Pattern:
    """WORDS for lower-cased characters below U+0300 (of which one becomes i and U+0307)."""
    kind = lambda c: "".join(re.escape(chr(i)) for i in range(0x308) if unicodedata.category(chr(i))[0] == c)
    letters, numbers, spaces = kind("L"), kind("N"), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


_LOW_WORDS = _low_words()
#: First letters of what is remembered, if it isn't a word: two that no word begins with, being white space.
_PIECE, _ADDED = "\t", "\n"
_MARKS = _PIECE + _ADDED


def byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of a tokenizer file whose model is BPE with end-of-word marks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["byte_fallback"] or model["dropout"] or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("a BPE model without byte fallback, dropout, post-processor and decoder is needed")
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]])
        known = json.dumps([{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}, WORDS])
        self.fast = steps == known
        library = Tokenizer.from_file(path)  # its normaliser and word split; the merging is ours
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        pairs: dict[int, tuple[int, int]] = {}
        self.size = len(self.vocab) + 1
        for r, (a, b) in enumerate(model["merges"]):
            pairs.setdefault(self.vocab[a] * self.size + self.vocab[b], (r, self.vocab[a + b]))
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys.tolist()), -1])
        self.merge = {r: (*divmod(k, self.size), new) for k, (r, new) in pairs.items()}
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], dtype=np.int64)
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that are matched literally are needed")
        self.added = {t["content"]: t["id"] for t in added}
        self.names |= {i: s for s, i in self.added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.memory: dict[str, tuple[str, str]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it has none."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words (not empty), by the pair occurrence index over all of them."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        # a word's last byte bears the end mark; -1 stands between words, so that no pair reaches across
        gap = ends + np.arange(len(words))
        symbol = np.full(len(raw) + len(words) + 1, -1, np.int64)
        inner = np.ones(len(symbol), bool)
        inner[gap] = False
        inner[-1] = False
        symbol[inner] = self.first[raw]
        symbol[gap - 1] = self.last[raw[ends - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1)
        after[-1] = n - 1
        before = np.arange(-1, n - 1)  # the first one's is the last, which is no symbol
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            """Adds positions to the lists of their ranks."""
            if len(at) == 1:
                groups = ((int(rank[0]), at),)
            else:
                order = np.argsort(rank, kind="stable")
                rank, at = rank[order], at[order]
                cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut)) if len(cut) else ((int(rank[0]), at),)
            for r, part in groups:
                have = index.get(r)
                if have is None:
                    index[r] = [part]
                    heapq.heappush(heap, r)
                else:
                    have.append(part)

        rank = self._ranks(symbol[:-1], symbol[1:])
        at = np.flatnonzero(rank >= 0)
        if len(at):
            note(at, rank[at])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, new = self.merge[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols, every second one, from the left
                at = np.unique(at)
                keep, taken = np.ones(len(at), bool), -1
                for k, (i, j) in enumerate(zip(at.tolist(), after[at].tolist())):
                    keep[k] = i != taken
                    if keep[k]:
                        taken = j
                at = at[keep]
            if len(at) == 0:
                continue
            gone = after[at]
            symbol[at] = new
            symbol[gone] = -2
            right = after[gone]
            after[at] = right
            before[right] = at
            left = before[at]
            place = np.concatenate((left, at))
            rank = self._ranks(symbol[place], symbol[np.concatenate((at, right))])
            good = rank >= 0
            if good.any():
                note(*(x[good] for x in (place, rank)))
        symbol[-1] = -2
        left = symbol[symbol != -2]
        cut = np.flatnonzero(left == -1)
        ids = left.tolist()
        return [ids[i:j] for i, j in zip([0, *(cut[:-1] + 1).tolist()], cut.tolist())]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' own strings, a space between two."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def _learn(self, words: list[str], pieces: list[str]) -> None:
        """Remembers (ids in decimal, decoded text) of words in plain letters and of pieces of text."""
        byte_of, place = self.byte_of, {}
        made = [[bytes(map(byte_of.__getitem__, w)) for w, _ in self.split(self.normalize(p))] for p in pieces]
        for w in (*(w.encode() for w in words), *(w for own in made for w in own)):
            place.setdefault(w, len(place))
        ids = self.encode_words([*place])
        text = [*map(str, range(self.size + len(self.added)))]
        for w in words:
            own = ids[place[w.encode()]]
            self.memory[w] = " ".join([text[i] for i in own]), self.decode(own)
        for p, split in zip(pieces, made):
            own = [i for w in split for i in ids[place[w]]]
            self.memory[_PIECE + p] = " ".join([text[i] for i in own]), self.decode(own)

    def _parts(self, text: str) -> list[str]:
        """Words, or pieces behind the mark of a piece."""
        if self.fast and _HIGH.search(text) is None:
            return _LOW_WORDS.findall(text.lower())
        out: list[str] = []
        for x in _GAP.split(text):
            if self.fast and x and _HIGH.search(x) is None:
                out.extend(_LOW_WORDS.findall(x.lower()))
            elif x:
                out.append(_PIECE + x)
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids in decimal joined by a space, decoded text) of every text."""
        split: list[list[str]] = []
        memory = self.memory
        for t in texts:
            if self.cut is not None and self.cut.search(t):
                parts: list[str] = []
                for k, part in enumerate(self.cut.split(t)):
                    parts.extend([_ADDED + part] if k % 2 else self._parts(part))
            else:
                parts = self._parts(t)
            split.append(parts)
        seen = set().union(*split)
        new = [p for p in seen if p not in memory]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = list(seen)
        self._learn([p for p in new if p[0] not in _MARKS], [p[1:] for p in new if p[0] == _PIECE])
        memory.update({_ADDED + content: (str(i), content) for content, i in self.added.items()})
        out = []
        for parts in split:
            got = [*map(memory.__getitem__, parts)]
            ids = " ".join([g[0] for g in got if g[0]])
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join([g[1] for g in got if g[0]])))
        return out


_loaded: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_column(df: DataFrame, text: str, path: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = True) -> DataFrame:
    """The `keep` columns with n_tokens and the ids and decoded text, as SHA-256 digests or (digests=False) themselves.

    Null and empty texts have no tokens and decode to the empty text.  Rows are
    independent of one another, whatever is repeated or null in them; other
    columns are ignored, whatever their names; an empty table gives an empty
    table.  A very long text is a block of its own, encoded whole.
    """
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            column = b.column(b.num_columns - 1)
            offsets, _ = text_buffers(column)
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                got = bpe.encode_texts([t or "" for t in column.slice(i, j - i).to_pylist()])
                if digests:
                    ids = pa.array([sha(g[1]) for g in got], pa.string())
                else:
                    flat = np.fromstring(" ".join([g[1] for g in got if g[0]]), np.int32, sep=" ")
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(g[0] for g in got)]).astype(np.int32)), pa.array(flat))
                decoded = pa.array([sha(g[2]) if digests else g[2] for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array([g[0] for g in got], pa.int64()), ids, decoded], names=[*b.schema.names[:-1], "n_tokens", *names])
                del got
        bpe.memory.clear()
        give_back()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    return df.select(*keep, F.col(text).alias(unused(keep, "_text")[0])).mapInArrow(encode, ", ".join([*kept, "n_tokens long", *(f"{n} {t}" for n, t in zip(names, kinds))]))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document under word_bpe_49k.json, encoded and decoded."""
    import public_tokenizers

    from .common import table

    return encode_column(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("word_bpe_49k.json"))
