"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte trigrams, hashed to 2**17 buckets.  Each is
scaled by the log ratio of its counts in the two classes, counted over all
labelled rows that may be learnt from; rows are then scaled to length one.  A
linear model with hinge loss is fitted by dual coordinate descent on a bounded
sample of those rows (`FIT_ROWS`), and a logistic curve through the margins of
rows that it wasn't fitted on turns margins into probabilities.

Labels, language, source and id are no features.  Null texts count as empty;
an empty text has no feature and gets the score of a margin of the bias alone.
Without labelled rows of both classes every score is the share of good labels
(0.5 without any).  Several labels of an id count as their mean, from 0.5 on as
good; null labels and labels without an id are left out.  Rows of equal id and
text count each in the class counts and, as each may be drawn, in the fit.  An
empty table of documents gives an empty table; columns are passed through or
ignored, whatever their names.  A very long text is one row like another: its
trigrams are made in memory at once, some 30 bytes for each byte.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, unused
from .language_model import gram_keys
from .textkernel import give_back, mix, row_blocks, text_buffers

BITS, PIECE = 17, 512 << 10
#: The most rows that the linear model is fitted on: those with the least hashes of id and text.
FIT_ROWS = 8192
#: Labels up to this number (16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_LABELS = 500_000
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
_SHIFT = np.uint64(64 - BITS)


def trigram_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct buckets of each row's whole text."""
    offsets, raw = text_buffers(column)
    seen = np.zeros(1 << BITS, bool)
    for i, j in row_blocks(offsets, PIECE):
        o = offsets[i : j + 1] - offsets[i]
        buckets = (mix(gram_keys(o, raw[offsets[i] : offsets[j]], 2)) >> _SHIFT).astype(np.int64)
        ends = o + np.arange(len(o))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = buckets[a + 1 : b] if b - a > 1 else buckets[:0]  # the first byte has no context, the empty text no byte
            seen[own] = True
            found = np.flatnonzero(seen) if len(own) > 4096 else np.unique(own)
            seen[own] = False
            yield found


class Model:
    """Weights by bucket (log-count ratios included), bias and the curve's two numbers."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.ratio2, self.weight, self.bias, self.slope, self.shift = ratio**2, ratio * weight, bias, slope, shift

    def score(self, buckets: np.ndarray) -> float:
        length = math.sqrt(self.ratio2[buckets].sum())
        margin = self.weight[buckets].sum() / length + self.bias if length else self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.shift))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge-loss model; the bias is a feature of value 1."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([(v * v).sum() + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            g = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by Newton steps, with the targets drawn in a little from 0 and 1."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, math.log((up + 1) / (down + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    size = 1 << BITS
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.avg(label).alias("l")).filter("l is not null").select(F.col(doc_id).alias("id"), (F.col("l") >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.filter(may_learn).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(known, "id").select("y", F.pmod(F.xxhash64("id", "t"), F.lit(1 << 40)).alias("h"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        docs_of = np.zeros(2, np.int64)
        for b in batches:
            for y, found in zip(b.column(0).to_pylist(), trigram_sets(b.column(2))):
                total[y, found] += 1
                docs_of[y] += 1
        give_back()
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([int(docs_of[y])], pa.int64()), pa.array([zlib.compress(total[y].tobytes(), 1)], pa.binary())], names=["y", "docs", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        return pa.table({"y": table.column("y").slice(0, 1), "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    counts, docs_of = np.zeros((2, size)), [0, 0]
    for r in rows.mapInArrow(count, "y int, docs long, counts binary").groupBy("y").applyInArrow(add, "y int, docs long, counts binary").collect():  # two rows, 1 MB each
        counts[r["y"]], docs_of[r["y"]] = np.frombuffer(r["counts"], np.int64), r["docs"]
    if not all(docs_of):
        share = docs_of[1] / sum(docs_of) if sum(docs_of) else 0.5
        odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, odds)
    smooth = counts + SMOOTH
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype(np.int32) for x in trigram_sets(b.column(2))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed], names=["y", "h", "f"])
        give_back()

    # a hash keeps few more than fit_rows, but for repeated rows; the limit keeps no more than that in any case
    share = min(1.0, 1.2 * (fit_rows + 100) / sum(docs_of))
    chosen = rows.filter(F.col("h") < int(share * (1 << 40))).orderBy("h", "y", F.xxhash64("t")).limit(fit_rows)
    sample = chosen.mapInArrow(features, "y int, h long, f array<int>").toArrow().combine_chunks()
    order = np.argsort(sample.column("h").to_numpy(), kind="stable")
    lists = sample.column("f")
    lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    y = np.where(sample.column("y").to_numpy()[order] > 0, 1.0, -1.0)
    data = []
    for r in order.tolist():
        at = flat[ends[r] : ends[r + 1]]
        v = ratio[at]
        data.append((at, v / max(math.sqrt((v * v).sum()), 1e-12)))
    fit = [i for i in range(len(data)) if i % 5]
    rest = [i for i in range(len(data)) if i % 5 == 0]
    if len({*y[fit]}) < 2 or len({*y[rest]}) < 2:
        fit = rest = [*range(len(data))]
    w, bias = dual_coordinate_descent([data[i] for i in fit], y[fit], size)
    margin = np.array([w[data[i][0]] @ data[i][1] + bias for i in rest])
    slope, shift = logistic_curve(margin, y[rest]) if len(rest) else (1.0, 0.0)
    return Model(ratio, w, bias, slope, shift)


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The `keep` columns with score and predicted (by these or other names), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 1 MB
    at = keep.index(text) if text in keep else len(keep)  # the text goes to Python once

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.fromiter(map(shared.value.score, trigram_sets(b.column(at))), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *names])
        give_back()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return docs.select(*keep, *([] if text in keep else [F.col(text).alias(unused(keep, "_text")[0])])).mapInArrow(score, ", ".join([*kept, f"`{names[0]}` double, `{names[1]}` int"]))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; labels with crc32(doc_id) mod 5 of 0 are held out."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = learn(docs, table(spark, sf_dir, "labels"), ~held)
    return score_quality(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))
