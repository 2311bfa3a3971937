"""Context-tree weighting over bytes.

The next byte is decomposed into eight binary decisions, each with a context
tree of its own over the last `DEPTH` bytes.  Every node has the counts of its
zeros and ones in the training texts and their Krichevsky-Trofimov estimate;
a node's weighted probability is the mean of its own estimate and the product of
its children's weighted probabilities.  A decision's probability is the mixture
over all depths that these weights give, and a text's score the sum over its
bytes and one end symbol.  The end, and what is before a text's start, is the
byte 0xFF: UTF-8 never has it, so it is a symbol of its own, and no text can
share a context with a text's start.

How it is distributed: documents are dealt into blocks of bounded bytes by a
hash.  A block sends each distinct (context, byte) and each distinct word once,
sorted and packed, to the shard that owns it.  A shard owns whole subtrees (by
the last two bytes), sums the counts of all blocks, and gives back to each block
what it asked for.  The nodes above the subtrees - at most 256 contexts, 65,280
nodes - are all that passes the driver.  So nothing that grows with the corpus
is broadcast or gathered, and no row leaves a block but packed keys.

Defined cases: null and empty texts are the end symbol alone; repeated rows have
equal results, and each counts in training; a null id counts as the empty text
where training rows are chosen; other columns are ignored, whatever their names.
An empty table gives an empty table.  Of a text longer than `PIECE` the keys are
made at once (some 60 bytes for each of its bytes); a block holds whole texts.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, materialize, spread_keys
from .textkernel import mix, row_blocks, text_buffers, words_by_row

#: Context bytes by default; bytes of text in a block and in one kernel call.
DEPTH, BLOCK, PIECE = 5, 24 << 20, 1 << 20
#: Keys that a block gathers before it merges them.
MERGE_AT = 1_000_000
_U = np.uint64
#: The end of a text and all that is before its start.
EDGE = 0xFF
_END = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)  # the end as a word
GRAM, WORD = 0, 1


# ---- the model -------------------------------------------------------------

_TABLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(4096) + 0.5))))


def _log_rising(n: np.ndarray) -> np.ndarray:
    """log of 1/2 * 3/2 * ... with n factors."""
    n = n.astype(np.float64)
    z = np.maximum(n, 1) + 0.5
    far = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) - math.lgamma(0.5)
    return np.where(n < 4096, _TABLE[np.minimum(n, 4096).astype(np.int64)], far)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    z = np.maximum(n.astype(np.float64), 0) + 1
    far = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    near = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4096)))))
    return np.where(z <= 4096, near[np.minimum(z - 1, 4095).astype(np.int64)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any one sequence with these counts."""
    return _log_rising(zeros) + _log_rising(ones) - _log_factorial(zeros + ones)


class Level:
    """Nodes of one depth for one of the eight decisions."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.node, self.zeros, self.ones = node, zeros, ones  # node: of each (context, byte) entry
        self.log_e = log_kt(zeros, ones)
        self.log_w = self.log_e

    def weigh(self, children: np.ndarray) -> None:
        """children: summed log weights of the nodes below."""
        self.log_w = np.logaddexp(self.log_e, children) - math.log(2)

    def share(self) -> np.ndarray:
        """Weight of the node's own estimate against what is below."""
        return np.exp(np.minimum(self.log_e - math.log(2) - self.log_w, 0))


class Subtrees:
    """All nodes from depth `top` down to `depth` over sorted distinct keys with counts.

    A key has the last byte of its context first and the next byte last, in
    depth + 1 bytes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> None:
        self.top, self.depth = top, depth
        self.entries: dict[int, np.ndarray] = {depth: keys}
        self.up: dict[int, np.ndarray] = {}  # entry at depth d -> entry at depth d - 1
        amount = {depth: counts.astype(np.float64)}
        for d in range(depth, top, -1):
            shorter = keys_at(self.entries[d], 1)
            self.entries[d - 1], self.up[d] = np.unique(shorter, return_inverse=True)
            amount[d - 1] = np.bincount(self.up[d], weights=amount[d], minlength=len(self.entries[d - 1]))
        self.levels: dict[tuple[int, int], Level] = {}
        for d in range(depth, top - 1, -1):
            e = self.entries[d]
            for j in range(8):
                group = e >> _U(8 - j)
                first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                node = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).astype(np.int64))))
                one = (e >> _U(7 - j) & _U(1)).astype(bool)
                ones = np.bincount(node, weights=np.where(one, amount[d], 0), minlength=len(first))
                level = Level(node, np.bincount(node, weights=amount[d], minlength=len(first)) - ones, ones)
                level.first = first
                if d < depth:
                    below = self.levels[d + 1, j]
                    level.weigh(np.bincount(node[self.up[d + 1][below.first]], weights=below.log_w, minlength=len(first)))
                self.levels[d, j] = level

    def predict(self) -> np.ndarray:
        """Probability of each of the eight bits of every entry's byte, mixed over the depths here."""
        out = np.empty((8, len(self.entries[self.depth])))
        for j in range(8):
            at = np.arange(len(self.entries[self.depth]))
            p = np.zeros(0)
            for d in range(self.depth, self.top - 1, -1):
                level = self.levels[d, j]
                node = level.node[at]
                one = (self.entries[d][at] >> _U(7 - j) & _U(1)).astype(bool)
                kt = (np.where(one, level.ones[node], level.zeros[node]) + 0.5) / (level.zeros[node] + level.ones[node] + 1)
                own = level.share()[node] if d < self.depth else 1.0
                p = kt if d == self.depth else own * kt + (1 - own) * p
                if d > self.top:
                    at = self.up[d][at]
            out[j] = p
        return out


def keys_at(keys: np.ndarray, less: int) -> np.ndarray:
    """Keys with a context shorter by `less` bytes."""
    return (keys >> _U(8 * (less + 1))) << _U(8) | (keys & _U(255))


#: Nodes of depths 1 and 0, by context byte, decision and bits so far.
TOP_NODES = 256 * 8 * 256


def _top_ids(context: np.ndarray, j: int, byte: np.ndarray) -> np.ndarray:
    return (context.astype(np.int64) * 8 + j) * 256 + (byte.astype(np.int64) >> (8 - j))


class Top:
    """Nodes of depths 1 and 0, from the sums over all subtrees."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> None:
        self.zeros, self.ones = zeros, ones
        one = Level(np.zeros(0, np.int64), zeros, ones)
        one.weigh(children)
        self.share1 = one.share()
        fold = lambda a: a.reshape(256, -1).sum(axis=0)
        self.zeros0, self.ones0 = fold(zeros), fold(ones)
        zero = Level(np.zeros(0, np.int64), self.zeros0, self.ones0)
        zero.weigh(fold(np.where(zeros + ones > 0, one.log_w, 0)))
        self.share0 = zero.share()

    def log10(self, keys: np.ndarray, below: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 of each key's byte, `below` from the subtrees."""
        context, byte = keys >> _U(8 * depth), keys & _U(255)
        total = np.zeros(len(keys))
        for j in range(8):
            i1 = _top_ids(context, j, byte)
            i0 = _top_ids(np.zeros(len(keys), np.int64), j, byte)
            one = (byte >> _U(7 - j) & _U(1)).astype(bool)
            kt = lambda z, o: (np.where(one, o, z) + 0.5) / (z + o + 1)  # noqa: B023, E731
            p = self.share1[i1] * kt(self.zeros[i1], self.ones[i1]) + (1 - self.share1[i1]) * below[j]
            p = self.share0[i0] * kt(self.zeros0[i0], self.ones0[i0]) + (1 - self.share0[i0]) * p
            total += np.log10(p)
        return total


# ---- texts as keys ---------------------------------------------------------


def gram_keys(offsets: np.ndarray, raw: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A key for every byte of every row and its end, row after row."""
    n = np.diff(offsets)
    rows = len(n)
    wide = np.full(len(raw) + rows * (depth + 1), EDGE, np.uint8)
    place = np.ones(len(wide), bool)
    starts = offsets[:-1] + np.arange(rows) * (depth + 1)
    pad = (starts[:, None] + np.arange(depth)).reshape(-1)
    place[pad] = False
    text = place.copy()
    text[starts + depth + n] = False
    wide[text] = raw
    at = np.flatnonzero(place)
    key = np.zeros(len(at), np.uint64)
    for back in range(1, depth + 1):
        key = key << _U(8) | wide[at - back]
    return key << _U(8) | wide[at]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1])))
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def _one(column) -> pa.Array:
    """A column as a single array."""
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _pieces(table: pa.Table):
    """(row range, offsets, bytes) of pieces of the column `t`."""
    offsets, raw = text_buffers(_one(table.column("t")))
    for i, j in row_blocks(offsets, PIECE):
        yield i, j, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    step = np.diff(keys, prepend=_U(0))
    return zlib.compress(len(keys).to_bytes(8, "little") + step.tobytes() + values.tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.frombuffer(raw, np.uint64, n, 8), dtype=np.uint64), np.frombuffer(raw, kind, n, 8 + 8 * n)


def _owner(keys: np.ndarray, kind: int, shards: int, depth: int) -> np.ndarray:
    return (mix(keys >> _U(8 * (depth - 1)) if kind == GRAM else keys) % _U(shards)).astype(np.int64)


# ---- the query -------------------------------------------------------------


def _ask(shards: int, depth: int, names: list[int]):
    def ask(table: pa.Table) -> pa.Table:
        held = table.column("held").to_numpy()
        parts = {GRAM: ([], []), WORD: ([], [])}

        def add(kind: int, keys: np.ndarray, train: np.ndarray) -> None:
            k, c = np.unique(keys[train], return_counts=True)
            other = np.unique(keys[~train]) if not train.all() else keys[:0]
            parts[kind][0].extend((k, other))
            parts[kind][1].extend((c.astype(np.int64), np.zeros(len(other), np.int64)))
            if sum(map(len, parts[kind][0][1:])) > MERGE_AT:  # what is merged already doesn't count
                k, c = _merge(*parts[kind])
                parts[kind] = [k], [c]

        for i, j, offsets, raw in _pieces(table):
            train = ~held[i:j]
            add(GRAM, gram_keys(offsets, raw, depth), np.repeat(train, np.diff(offsets) + 1))
            bounds, words = words_by_row(offsets, raw)
            add(WORD, words, np.repeat(train, np.diff(bounds)))
        parts[WORD][0].append(_END)
        parts[WORD][1].append(np.array([(~held).sum()]))
        rows = []
        for kind, (keys, counts) in parts.items():
            k, c = _merge(keys, counts)
            owner = _owner(k, kind, shards, depth)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(shards + 1))
            for s in range(shards):
                mine = order[cuts[s] : cuts[s + 1]]
                if len(mine):
                    rows.append({"kind": kind, "shard": names[kind * shards + s], "block": table.column("block")[0].as_py(), "asked": _pack(k[mine], c[mine])})
        return pa.Table.from_pylist(rows, pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("asked", pa.binary())]))

    return ask


def _gather(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    asked = [_unpack(x.as_py(), np.int64) for x in table.column("asked")]
    keys, counts = _merge([k for k, _ in asked], [c for _, c in asked])
    return [k for k, _ in asked], keys, counts


def _stats(depth: int):
    """Of a shard: sums for the nodes of depth 1 (id, zeros, ones, children), or for id -1 its words: (distinct, all)."""

    def stats(table: pa.Table) -> pa.Table:
        _, keys, counts = _gather(table)
        if table.column("kind")[0].as_py() == WORD:
            out = [[-1], [int((counts > 0).sum())], [int(counts.sum())], [0.0]]
        else:
            tree = Subtrees(keys, counts, 2, depth)
            e = tree.entries[2]
            sums = np.zeros((3, TOP_NODES))
            for j in range(8):
                level = tree.levels[2, j]
                ids = _top_ids(e[level.first] >> _U(16), j, e[level.first] & _U(255))
                for row, values in zip(sums, (level.zeros, level.ones, level.log_w)):
                    row += np.bincount(ids, weights=values, minlength=TOP_NODES)
            ids = np.flatnonzero(sums[0] + sums[1])
            out = [ids, sums[0][ids].astype(np.int64), sums[1][ids].astype(np.int64), sums[2][ids]]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("id", "zeros", "ones", "children"), out, (pa.int32(), pa.int64(), pa.int64(), pa.float64()))})

    return stats


def _answer(top, depth: int):
    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        asked, keys, counts = _gather(table)
        values = counts.astype(np.float64) if kind == WORD else top.value.log10(keys, Subtrees(keys, counts, 2, depth).predict(), depth)
        packed = [_pack(k, values[np.searchsorted(keys, k)]) for k in asked]
        return pa.table({"kind": table.column("kind"), "block": table.column("block"), "answer": pa.array(packed, pa.binary())})

    return answer


def _score(train_tokens: int, distinct: int, depth: int):
    base = math.log10(train_tokens + distinct + 1)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = {}
        kinds = answers.column("kind").to_numpy()
        for kind in (GRAM, WORD):
            parts = [_unpack(answers.column("answer")[int(r)].as_py(), np.float64) for r in np.flatnonzero(kinds == kind)]
            k, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(k)
            found[kind] = k[order], v[order]

        def values(kind: int, keys: np.ndarray) -> np.ndarray:
            k, v = found[kind]
            distinct, at = np.unique(keys, return_inverse=True)  # sorted lookups stay in the cache
            return v[np.searchsorted(k, distinct)][at]

        end = values(WORD, _END)[0]
        n, known, base_score, total = [], [], [], []
        for _, _, offsets, raw in _pieces(docs):
            log_p = np.concatenate(([0.0], np.cumsum(values(GRAM, gram_keys(offsets, raw, depth)))))
            ends = offsets + np.arange(len(offsets))
            total.append(log_p[ends[1:]] - log_p[ends[:-1]])
            bounds, words = words_by_row(offsets, raw)
            c = values(WORD, words)
            sums = np.concatenate(([0.0], np.cumsum(np.log10(c + 1))))
            seen = np.concatenate(([0], np.cumsum(c > 0)))
            tokens = np.diff(bounds) + 1
            n.append(tokens)
            known.append(seen[bounds[1:]] - seen[bounds[:-1]] + int(end > 0))
            base_score.append(sums[bounds[1:]] - sums[bounds[:-1]] + math.log10(end + 1) - tokens * base)
        join = lambda x, t: pa.array(np.concatenate(x), t)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": join(n, pa.int64()), "n_known": join(known, pa.int64()), "train_tokens": pa.array(np.full(len(docs), train_tokens)), "base_score": join(base_score, pa.float64()), "score": join(total, pa.float64()), "n_bytes": pa.array(np.diff(text_buffers(_one(docs.column("t")))[0]))})

    return score


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score_texts(df: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Scores of every row under the model of the rows that aren't held out; code length per byte is -score / n_bytes / log10(2).

    `depth` is the number of context bytes, from 2 to 7.
    """
    if not 2 <= depth <= 7:
        raise ValueError("the depth is from 2 to 7: a key has 64 bits")
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-size // BLOCK))
    shards = max(spark.sparkContext.defaultParallelism * 2, blocks)
    # as many partitions as blocks and shards, under names that part them: no task has two
    number = F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)).cast("int")
    if blocks <= 4096:
        number = F.element_at(F.array(*map(F.lit, spread_keys(spark, blocks))), number + 1)
    rows = rows.withColumn("block", number).repartition(blocks, "block")
    asked = materialize(rows.groupBy("block").applyInArrow(_ask(shards, depth, spread_keys(spark, 2 * shards)), "kind int, shard int, block int, asked binary"), "asked")
    by_shard = asked.repartition(2 * shards, "shard").groupBy("shard")
    stats = by_shard.applyInArrow(_stats(depth), "id int, zeros long, ones long, children double")
    sums = stats.groupBy("id").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children")).collect()  # TOP_NODES rows at most
    zeros, ones, children = np.zeros(TOP_NODES), np.zeros(TOP_NODES), np.zeros(TOP_NODES)
    distinct = train = 0
    for r in sums:
        if r["id"] < 0:
            distinct, train = r["zeros"], r["ones"]
        else:
            zeros[r["id"]], ones[r["id"]], children[r["id"]] = r["zeros"], r["ones"], r["children"]
    top = spark.sparkContext.broadcast(Top(zeros, ones, children))
    answers = materialize(by_shard.applyInArrow(_answer(top, depth), "kind int, block int, answer binary"), "answers")
    return rows.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_score(train, distinct, depth), SCORES)


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    """All documents under the model of those with crc32(doc_id) mod 7 other than 2."""
    from .common import table

    return score_texts(table(spark, sf_dir, "documents"), F.pmod(crc_of_id(), F.lit(7)) == 2)
