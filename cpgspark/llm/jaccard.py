"""Exact Jaccard join of documents as a metric-space join.

A document is its set of word shingles, a point of the space under the Jaccard
distance.  Documents link when the similarity is at least p/q, that is within
the distance 1 - p/q.  The size of the symmetric difference obeys the triangle
inequality as well; for linked sets it is at most (q-p)/(q+p) of the sizes' sum.

1. The whole space is cut into pieces that no link crosses.  Documents as pivots
   can't do that: nearly all documents are at distance one from all pivots, so
   every window is the space (figures in the README).  This step is a prefix
   filter: linked sets lack at most n - ceil(n*p/q) of each other's shingles, so
   each document goes to the regions of its first n - ceil(n*p/q) + 1 shingles,
   rarest first, and linked documents meet in one.  In a region, sizes too far
   apart are parted, and so are sets whose counts of shingles by hash - their
   distances to sets fixed beforehand - differ by more than the bound: by the
   triangle inequality they can't link.  The connected pieces that are left are
   closed under links and get their documents' sets once.
2. A piece that is too large for a task is measured against a pivot of its own,
   the set that most rows have.  Documents within the link distance of the pivot
   are linked to it and so to each other.  The rest is joined with itself and
   with those that a window of the triangle inequality replicates: documents at
   the pivot's side of the border whose distance to the pivot is within the link
   distance of the rest's.  What is still too large is dealt out as pairs of
   blocks of the rest, or of the rest and the window.
3. Within a task, pivot documents create Voronoi regions: a document is at home
   with its nearest pivot and is replicated to each whose distance is within the
   window of twice the link distance.  Regions are joined recursively, and
   compared exactly when they are small or no pivot parts them.

Only links that join two parts of a region are passed on: one row per document
at most for each task, never the pairs of a group.  Equal sets are one class
from the start, so exact copies cost one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .textkernel import _STEP, give_back, mix, row_blocks, shingle_sets, text_buffers

#: Bytes of text that one kernel call takes.
BLOCK_BYTES = 2 << 20
#: Rows of a shingle's region in one task.
REGION_ROWS = 512
#: Documents and shingles of a connected region in one task; documents compared at once without a further pivot.
TASK_DOCS, TASK_SHINGLES, LEAF = 1024, 4 << 20, 128
#: Bytes of a task's texts from which its memory is given back.
LARGE = 4 << 20
#: Classes with a possible partner (about 60 bytes each) up to this number are broadcast to find their texts, more are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Shingles are counted in 2**20 bins by hash; the table is 8 MB for any corpus.
FREQUENCY_BITS, CHUNKS = 20, 16
_U = np.uint64
_SHIFT = _U(64 - FREQUENCY_BITS)


class Threshold:
    """Similarity p/q in whole numbers."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.reach = 1 - p / q  # the distance up to which documents link

    def linked(self, both: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return self.q * both >= self.p * (n1 + n2 - both)

    def regions(self, s: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The pivots, in their order, in whose regions a set (sorted hashes) has to be."""
        window = len(s) + (-len(s) * self.p // self.q) + 1
        late = level[(s >> _SHIFT).astype(np.int64)]
        if not late.any():
            return s[:window]
        return s[np.argsort(late, kind="stable")[:window]]


def _fingerprint(s: np.ndarray) -> np.ndarray:
    """Two independent sums over a set, as signed longs."""
    sums = np.array([mix(s ^ _STEP[7]).sum(dtype=np.uint64), mix(s * _STEP[9]).sum(dtype=np.uint64)])
    return mix(sums ^ _U(len(s))).view(np.int64)


def _counts(s: np.ndarray) -> bytes:
    """How many of a set's shingles have each value of the first bits of their hash, up to 15, two to a byte.

    There are 128 values, or more for a larger set: 4 to 8 shingles for each, up to 65,536 values.  A
    count cut at 15 never adds to a distance.
    """
    bits = min(max(7, (len(s) - 1).bit_length() - 3), 16)
    c = np.minimum(np.bincount((mix(s) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (c[::2] | c[1::2] << 4).tobytes()


class _Vectors:
    """Counts of many sets; of two with different numbers of values, the longer is folded to the shorter."""

    def __init__(self, packed: pa.Array) -> None:
        size = np.asarray(pa.compute.binary_length(packed)).astype(np.int64)
        self.bits = np.frexp(size)[1].astype(np.int64)  # of a power of two: its place, and one more
        self.rows, self.place = {}, np.zeros(len(size), np.int64)
        for b in np.unique(self.bits).tolist():
            own = np.flatnonzero(self.bits == b)
            self.place[own] = np.arange(len(own))
            two = np.frombuffer(b"".join(packed.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), 1 << b - 1)
            wide = np.empty((len(own), 1 << b), np.int16)
            wide[:, ::2], wide[:, 1::2] = two & 15, two >> 4
            self.rows[b] = wide

    def folded(self, rows: np.ndarray, bits: int) -> np.ndarray:
        of = self.bits[rows]
        if (of == bits).all():
            return self.rows[bits][self.place[rows]]
        out = np.empty((len(rows), 1 << bits), np.int16)
        for b in np.unique(of).tolist():
            here = of == b
            sums = self.rows[b][self.place[rows[here]]]
            while sums.shape[1] > 1 << bits:
                sums = sums[:, ::2] + sums[:, 1::2]
            out[here] = sums
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """City-block distances of the rows i and j, pair by pair."""
        out = np.empty(len(i), np.int64)
        bits = np.minimum(self.bits[i], self.bits[j])
        for b in np.unique(bits).tolist():
            here = np.flatnonzero(bits == b)
            step = max(1, 1 << 20 >> b)
            for lo in range(0, len(here), step):
                at = here[lo : lo + step]
                out[at] = np.abs(self.folded(i[at], b) - self.folded(j[at], b)).sum(axis=1, dtype=np.int64)
        return out


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def frequency_levels(df: DataFrame, text: str, k: int) -> np.ndarray:
    """For each bin of shingle hashes 0, or how many times (as a power of 2, from 2 on) it has the mean number of documents.

    Counts every shingle of every document; each task sends one table of counts.
    """
    bins = 1 << FREQUENCY_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for b in batches:
            offsets, raw = text_buffers(b.column(0))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                sets = [*shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], k)]
                total += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=bins)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, CHUNKS)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    counted = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(count, "chunk int, counts binary")
    rows = counted.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # CHUNKS rows, 8 MB
    found = np.zeros((CHUNKS, bins // CHUNKS), np.int64)
    for r in rows:
        found[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    found = found.reshape(-1)
    times = found / max(found.mean(), 4.0)
    return np.where(times >= 4, np.log2(np.maximum(times, 1)), 0).astype(np.int8)


def document_sets(df: DataFrame, doc_id: str, text: str, k: int, threshold: Threshold, levels) -> DataFrame:
    """doc_id, tkey (digest of the text), n_shingles, f1, f2 and counts (of the set) and regions of every row."""
    out = "doc_id long, tkey binary, n_shingles long, f1 long, f2 long, counts binary, regions array<bigint>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, raw = text_buffers(b.column(2))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                n, f1, f2, counts, regions = [], [], [], [], []
                for s in shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], k):
                    n.append(len(s))
                    one, two = _fingerprint(s).tolist() if len(s) else (0, 0)
                    f1.append(one)
                    f2.append(two)
                    counts.append(_counts(s) if len(s) else b"")
                    regions.append(_signed(threshold.regions(s, levels.value)) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, regions)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(regions)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(counts, pa.binary()), listed], names=["doc_id", "tkey", "n_shingles", "f1", "f2", "counts", "regions"])
        give_back()

    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("tkey"), body.alias("t")).mapInArrow(sets, out)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of the sets of a with those of b (of a, if None)."""
    sets = a + (b or [])
    flat = np.concatenate(sets)
    every, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = count[place] > 1
    row, at = row[keep], column[place[keep]]
    out = np.zeros((len(a), len(b) if b else len(a)), np.int64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):  # columns in steps bound the matrix
        i, j = np.searchsorted(at, (lo, lo + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        out += np.rint(m[: len(a)] @ (m[len(a) :] if b else m).T).astype(np.int64)
    return out


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def join_region(sets: list[np.ndarray], threshold: Threshold, side: np.ndarray | None = None, joined: bool = False) -> list[tuple[int, int]]:
    """Links that span the components of the sets of one region.

    With `side` (0 or 1 for each set), only links between the sides count;
    `joined` says that all sets of side 1 are linked already.
    """
    forest, links = _Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    reach = threshold.reach
    if joined and side is not None:
        own = np.flatnonzero(side == 1).tolist()
        for x in own[1:]:
            forest.join(own[0], x)

    def exact(rows: np.ndarray, away: np.ndarray) -> None:
        n = sizes[rows]
        for lo in range(0, len(rows), LEAF):  # rows go by size, so blocks too far apart in it are left out
            for hi in range(lo, len(rows), LEAF):
                a, b = rows[lo : lo + LEAF], rows[hi : hi + LEAF]
                na, nb = n[lo : lo + LEAF], n[hi : hi + LEAF]
                if na.max() * threshold.q < nb.min() * threshold.p:
                    continue
                ok = (away[lo : lo + LEAF, None] & away[None, hi : hi + LEAF]) == 0
                ra, rb = np.array([forest.root(x) for x in a.tolist()]), np.array([forest.root(x) for x in b.tolist()])
                ok &= ra[:, None] != rb[None, :]  # what is linked already needs no further link
                if side is not None:
                    ok &= side[a][:, None] != side[b][None, :]
                if not ok.any():
                    continue
                both = _overlaps([sets[x] for x in a], [sets[x] for x in b] if hi > lo else None)
                ok &= threshold.linked(both, na[:, None], nb[None, :])
                x, y = np.nonzero(np.triu(ok, 1) if hi == lo else ok)
                for u, v in zip(a[x].tolist(), b[y].tolist()):
                    if forest.join(u, v):
                        links.append((u, v))

    def recurse(rows: np.ndarray, away: np.ndarray, level: int) -> None:
        """Bit l of `away`: at level l the row is a copy in another's region; of a pair, one must be at home at each level."""
        k = 8
        if len(rows) <= LEAF or level == 60:
            exact(rows, away)
            return
        pick = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
        both = np.concatenate([_overlaps([sets[x] for x in rows[i : i + LEAF]], [sets[p] for p in pick]) for i in range(0, len(rows), LEAF)])
        distance = 1 - both / (sizes[rows][:, None] + sizes[pick][None, :] - both)
        own = distance.argmin(axis=1)
        inside = distance <= distance.min(axis=1, keepdims=True) + 2 * reach + 1e-9
        if inside.sum() > 2 * len(rows) or inside.sum(axis=0).max() > 0.8 * len(rows):
            exact(rows, away)  # the windows hold nearly all: no pivot parts this region
            return
        for j in range(k):
            # a pair is in the regions of both homes; the first of the two owns it
            here = inside[:, j] & (own >= j)
            recurse(rows[here], away[here] | ((own[here] > j).astype(np.int64) << level), level + 1)

    order = np.argsort(sizes, kind="stable")
    recurse(order, np.zeros(len(order), np.int64), 0)
    return links


def _deal(rows: DataFrame, key: str, tasks: DataFrame, node: str) -> DataFrame:
    """Rows with the blocks x and y of each task that they are in; `tasks` has the key and its number of rows m.

    Keys of up to REGION_ROWS rows are one task, larger ones a task for each pair of blocks.
    """
    g = F.ceil(F.col("m") / F.lit(REGION_ROWS)).cast("int")
    placed = rows.join(tasks.withColumn("g", g).drop("m"), key).withColumn("block", F.pmod(F.xxhash64(node), F.col("g")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    return dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("g", "other")


def _part_regions(threshold: Threshold):
    """Edges (a, b) of the documents of each region (rows in order of region, x, y) that their counts don't part."""
    p, q = threshold.p, threshold.q

    def near(counts: _Vectors, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return counts.apart(i, j) * (q + p) <= (q - p) * (n[i] + n[j])

    def whole(at: np.ndarray, n: np.ndarray, block: np.ndarray, counts: _Vectors, two: bool) -> tuple[list[int], list[int]]:
        """A large region (the rows `at`): only edges that join parts of it, and only rows of different parts are compared."""
        at = at[np.argsort(n[at], kind="stable")]
        size, bits = n[at], counts.bits[at]  # both ascend
        ends = np.searchsorted(size, size * q // p, side="right")
        part, a, b = np.arange(len(at)), [], []
        side = block[at]
        for first in np.flatnonzero(np.diff(bits, prepend=0)).tolist():
            last = int(np.searchsorted(bits, bits[first], side="right"))
            own = counts.folded(at[first : ends[last - 1]], int(bits[first]))
            for i in range(first, last):
                j = i + 1 + np.flatnonzero(part[i + 1 : ends[i]] != part[i])
                if two:
                    j = j[side[j] != side[i]]
                if not len(j):
                    continue
                apart = np.abs(own[j - first] - own[i - first]).sum(axis=1, dtype=np.int64)
                found = j[apart * (q + p) <= (q - p) * (size[i] + size[j])]
                for of, k in zip(*(x.tolist() for x in np.unique(part[found], return_index=True))):
                    a.append(int(at[i]))
                    b.append(int(at[found[k]]))
                    part[part == of] = part[i]
        return a, b

    def edges(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        col = lambda c: rows.column(c).to_numpy()
        f, n, block, x, y = col("f1"), col("n_shingles").astype(np.int64), col("block"), col("x"), col("y")
        key = np.stack([col("region"), x.astype(np.int64), y.astype(np.int64)])
        packed = rows.column("counts").combine_chunks()
        counts = _Vectors(packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed)
        start = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0).any(axis=0))))
        size = np.diff(np.append(start, len(f)))
        a, b = [], []
        big = size > 16
        for s, m in zip(start[big].tolist(), size[big].tolist()):
            u, v = whole(np.arange(s, s + m), n, block, counts, bool(x[s] != y[s]))
            a.append(f[np.array(u, np.int64)])
            b.append(f[np.array(v, np.int64)])
        left = np.repeat(np.where(big, 0, np.append(start[1:], len(f))), size)  # end of each row's small region
        at = np.arange(len(f))
        for k in range(1, 16):
            i = np.flatnonzero((at + k < left) & ((x == y) | (block != np.roll(block, -k))))
            i = i[n[i + k] * p <= n[i] * q]  # rows go by size
            if len(i) == 0:
                continue
            i = i[near(counts, n, i, i + k)]
            a.append(f[i])
            b.append(f[i + k])
        return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["region", "x", "y"]

        def out(rows: pa.Table) -> pa.RecordBatch:
            a, b = edges(rows)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = [held.column(c)[-1] for c in names]
            same = np.logical_and.reduce([held.column(c).to_numpy() == v.as_py() for c, v in zip(names, last)])
            cut = int(np.argmax(same))  # the last region may go on in the next batch
            if cut:
                yield out(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield out(held.combine_chunks())
        give_back()

    return part


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _sets_of(table: pa.Table, words: int) -> list[np.ndarray]:
    column = table.column("t").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets, raw = text_buffers(column)
    sets: list[np.ndarray] = []
    for i, j in row_blocks(offsets, BLOCK_BYTES):
        sets += shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], words)
    return sets


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(rows / F.lit(TASK_DOCS), shingles / F.lit(TASK_SHINGLES))).cast("int")


def _measure(threshold: Threshold, words: int):
    """Of a part of a large piece: each document's distance to the piece's pivot, and whether it links."""

    def measure(table: pa.Table) -> pa.Table:
        lead = table.column("lead").to_numpy()
        sets = _sets_of(table, words)
        pivot = sets[int(np.argmax(lead))]
        rows = np.flatnonzero(~lead)
        both = np.array([np.isin(sets[r], pivot, assume_unique=True).sum() for r in rows.tolist()], np.int64)
        n = np.array([len(sets[r]) for r in rows.tolist()], np.int64)
        took = table.select(["component", "f1", "f2"]).take(pa.array(rows))
        distance = 1 - both / np.maximum(n + len(pivot) - both, 1)
        del sets
        give_back()
        return took.append_column("n", pa.array(n)).append_column("distance", pa.array(distance)).append_column("linked", pa.array(threshold.linked(both, n, len(pivot))))

    return measure


def _join_tasks(threshold: Threshold, words: int):
    """The links of one task, between different parts of it only."""

    def join(table: pa.Table) -> pa.Table:
        sets = _sets_of(table, words)
        keys = list(zip(table.column("f1").to_pylist(), table.column("f2").to_pylist()))
        first: dict[tuple[int, int], int] = {}
        rows = [r for r, key in enumerate(keys) if first.setdefault(key, r) == r]
        side = table.column("side").to_numpy()[rows]
        links = join_region([sets[r] for r in rows], threshold, side if side.any() else None, table.column("settled")[0].as_py())
        at = lambda k, c: pa.array([keys[rows[link[k]]][c] for link in links], pa.int64())
        if table.nbytes > LARGE:
            del sets
            give_back()
        return pa.table({"a1": at(0, 0), "a2": at(0, 1), "b1": at(1, 0), "b2": at(1, 1)})

    return join


def _join_pieces(brought: DataFrame, wanted: DataFrame, threshold: Threshold, words: int) -> DataFrame:
    """Links (a1, a2, b1, b2) that span the components of every piece; `brought` has component, f1, f2 and the text t of each class."""
    n_tasks = int(brought.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), F.max(F.struct("rows", "f1", "f2")).alias("p"))
    large = materialize(sizes.withColumn("g", _blocks(F.col("m"), F.col("s"))).filter("g > 1").select(F.col("component").alias("c"), "g", F.col("p.f1").alias("p1"), F.col("p.f2").alias("p2")), "large")
    n_large = large.count()
    alone = ["component", *(F.lit(0).alias(c) for c in ("x", "y")), F.lit(False).alias("settled"), F.lit(0).alias("side"), "f1", "f2", "t"]
    found, tasks = [], brought
    if n_large:
        brought = materialize(brought.join(_small(large, n_large), F.col("component") == F.col("c"), "left").drop("c"), "brought")
        tasks = brought.filter("g is null")
    tasks = tasks.select(*alone)
    if n_large:
        big = brought.filter("g is not null")
        docs = big.select("component", F.pmod(F.xxhash64("f1"), F.col("g")).cast("int").alias("x"), "f1", "f2", "t", F.lit(False).alias("lead"))
        leads = big.filter("f1 = p1 and f2 = p2").select("component", F.explode(F.expr("sequence(0, g - 1)")).alias("x"), "f1", "f2", "t", F.lit(True).alias("lead"))
        measured = docs.unionByName(leads).repartition(n_tasks, "component", "x").groupBy("component", "x").applyInArrow(_measure(threshold, words), "component long, f1 long, f2 long, n long, distance double, linked boolean")
        measured = materialize(measured, "measured")
        pivot = large.select(F.col("c").alias("component"), "p1", "p2")
        found.append(measured.filter("linked").join(_small(pivot, n_large), "component").filter("f1 <> p1 or f2 <> p2").select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("p1").alias("b1"), F.col("p2").alias("b2")))
        # the rest, and the window at the pivot's side
        rest = measured.filter("not linked").groupBy("component").agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.count(F.lit(1)).alias("r"), F.sum("n").alias("rs"))
        near = measured.join(_small(rest, n_large), "component").filter(F.expr("not linked") | F.col("distance").between(F.col("least") - threshold.reach - 1e-9, F.col("most") + threshold.reach + 1e-9))
        near = materialize(near.select("component", "f1", "f2", "linked", "n", "r", "rs"), "near")
        window = near.groupBy("component").agg(F.max("r").alias("r"), F.max("rs").alias("rs"), F.count(F.when(F.col("linked"), 1)).alias("w"), F.coalesce(F.sum(F.when(F.col("linked"), F.col("n"))), F.lit(0)).alias("ws"))
        window = window.select("component", _blocks(F.col("r"), F.col("rs")).alias("gr"), _blocks(F.col("w"), F.col("ws")).alias("gw"))
        dealt = big.join(near.select("component", "f1", "f2", "linked"), ["component", "f1", "f2"]).join(_small(window, n_large), "component")
        block = F.pmod(F.xxhash64("f1"), F.when(F.col("linked"), F.col("gw")).otherwise(F.col("gr"))).cast("int")
        dealt = dealt.withColumn("b", block).select("component", "f1", "f2", "t", "linked", "b", "gr", "gw")
        of_rest = dealt.filter("not linked").withColumn("o", F.explode(F.expr("sequence(0, gr - 1)")))
        inner = of_rest.select("component", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), F.lit(False).alias("settled"), F.expr("if(b = o, 0, int(b > o))").alias("side"), "f1", "f2", "t")
        across = dealt.filter("gw > 0").withColumn("o", F.explode(F.expr("if(linked, sequence(0, gr - 1), sequence(0, gw - 1))")))
        across = across.select("component", F.expr("if(linked, o, b)").alias("x"), F.expr("if(linked, b, o)").alias("y"), F.lit(True).alias("settled"), F.col("linked").cast("int").alias("side"), "f1", "f2", "t")
        tasks = tasks.unionByName(inner).unionByName(across)
    # one task works on many pieces, one after the other; their number isn't cut down by bytes, as the work isn't in proportion to them
    joined = tasks.repartition(n_tasks, "component", "x", "y", "settled").groupBy("component", "x", "y", "settled").applyInArrow(_join_tasks(threshold, words), "a1 long, a2 long, b1 long, b2 long")
    for more in found:
        joined = joined.unionByName(more)
    return materialize(joined, "links")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """doc_id, tkey, n_shingles and component_id of every row; see near_duplicate_groups."""
    return near_duplicate_groups(df, doc_id, text, words, p, q).drop("least")


def near_duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """doc_id, tkey (digest of the text), n_shingles and component_id of every row; links at similarity p/q of `words`-word shingles.

    Null and empty texts, and texts of white space, have no shingles and no
    links; their component is their own id.  Rows of equal id and text repeat
    their result.  A row without an id links like others, but never names a
    component; it has none if it only links with such rows.  `least` is the first row of the
    component by (doc_id with nulls last, tkey), without ids too; null for a row
    that is alone.  Other columns are ignored.
    """
    threshold = Threshold(p, q)
    levels = df.sparkSession.sparkContext.broadcast(frequency_levels(df, text, words))  # 1 MB
    docs = materialize(document_sets(df, doc_id, text, words, threshold, levels), "sets")
    named = docs.filter("n_shingles > 0")
    # classes of equal sets, each with one row whose text can be read again
    classes = named.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first"))
    classes = materialize(classes, "classes")

    # one row per class before its regions are listed; rows without a neighbour in the region whose size fits are out
    seen = materialize(named.groupBy("f1").agg(F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"), F.first("regions").alias("regions")), "seen")
    w = Window.partitionBy("region").orderBy("n_shingles", "f1")
    n, behind, ahead = F.col("n_shingles"), F.lag("n_shingles").over(w), F.lead("n_shingles").over(w)
    fits = F.coalesce(ahead * p <= n * q, F.lit(False)) | F.coalesce(n * p <= behind * q, F.lit(False))
    shared = seen.select("f1", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("regions").alias("region")).withColumn("fits", fits).filter("fits").select("f1", "region")
    shared = materialize(shared, "shared")
    dealt = _deal(shared, "region", shared.groupBy("region").agg(F.count(F.lit(1)).alias("m")), "f1").join(seen.drop("regions"), "f1")
    dealt = dealt.select("region", "x", "y", "f1", "block", "n_shingles", "counts").repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "n_shingles", "f1")
    region = materialize(components(dealt.mapInArrow(_part_regions(threshold), "a long, b long"), "a", "b"), "regions")

    # each text is read once for its class
    wanted = materialize(classes.join(region, classes.f1 == region.node).select(F.col("first.tkey").alias("k"), F.col("first.doc_id").alias("d"), "f1", "f2", "component", "rows", "n"), "wanted")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("t"), F.unhex(F.md5(body.cast("binary"))).alias("tkey"))
    asked = wanted.select("k", "d", "f1", "f2", "component")
    brought = texts.join(_small(asked, wanted.count()), (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("component", "f1", "f2", "t")
    links = _join_pieces(brought, wanted, threshold, words)
    name = lambda s: F.struct(F.col(f"{s}1").alias("f1"), F.col(f"{s}2").alias("f2"))
    found = components(links.select(name("a").alias("a"), name("b").alias("b")), "a", "b").select(F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2"), "component")
    whole = found.join(classes.select("f1", "f2", "first"), ["f1", "f2"])
    ends = whole.groupBy("component").agg(F.min("first").alias("least"))
    linked = whole.join(ends, "component").select("f1", "f2", "least")
    # classes of one row and without links are their own component: their rows need no join
    lone = classes.filter("rows > 1").join(linked.select("f1", "f2"), ["f1", "f2"], "left_anti").select("f1", "f2", F.col("first").alias("least"))
    of = materialize(linked.unionByName(lone), "classes")
    plain = docs.select("doc_id", "tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("f1")).alias("f1"), F.when(F.col("n_shingles") > 0, F.col("f2")).alias("f2"))
    out = plain.join(of.withColumnsRenamed({"f1": "g1", "f2": "g2"}), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    return out.select("doc_id", "tkey", "n_shingles", F.when(F.col("g1").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "least")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, similarity 0.9."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).drop("tkey")
