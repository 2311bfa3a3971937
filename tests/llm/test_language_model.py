"""Context-tree weighting against a direct recursion over nodes."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgspark.llm import language_model as lm

TEXTS = [(1, "the cat sat on the mat"), (2, "a cat the hat"), (9, ""), (10, None), (12, "\x00"), (13, "\x00\x00 the"), (3, "the mat\x00\xe9 sat"), (4, "zzz"), (4, "zzz"), (None, "on the")]


def direct(texts, train, depth):
    """log10 probability of each text, node by node."""
    counts = defaultdict(lambda: [0, 0])

    def events(text):
        raw = b"\xff" * depth + text.encode() + b"\xff"
        for i in range(depth, len(raw)):
            context = raw[i - depth : i][::-1]
            for j in range(8):
                yield context, (j, raw[i] >> (8 - j)), raw[i] >> (7 - j) & 1

    for t, use in zip(texts, train):
        if use:
            for c, b, bit in events(t):
                for d in range(depth + 1):
                    counts[c[:d], b][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)
    children = defaultdict(set)
    for c, b in counts:
        if c:
            children[c[:-1], b].add(c)

    def weight(c, b):
        e = kt(*counts[c, b])
        if len(c) == depth:
            return e
        below = sum(weight(x, b) for x in children[c, b])
        return math.log(0.5) + np.logaddexp(e, below)

    weights = {k: weight(*k) for k in [*counts]}

    def p(c, d, b, bit):
        z, o = counts.get((c[:d], b), (0, 0))
        own = ((o if bit else z) + 0.5) / (z + o + 1)
        if d == depth:
            return own
        share = math.exp(kt(z, o) + math.log(0.5) - weights.get((c[:d], b), 0.0))
        return share * own + (1 - share) * p(c, d + 1, b, bit)

    return [sum(math.log10(p(c, 0, b, bit)) for c, b, bit in events(t)) for t in texts]


@pytest.mark.parametrize("depth", [2, lm.DEPTH, 7])
def test_scores_equal_the_direct_recursion(spark, depth):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"score": F.lit(1), "block": F.lit("b"), "held": F.lit(None), "t": F.lit(2)})
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    got = sorted(lm.score_texts(df, held, depth=depth).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["score"]))
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0]))
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, _ in rows]
    want = direct([t or "" for _, t in rows], train, depth)
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-9)
    tokens = [(t or "").lower().split() for _, t in rows]
    c = defaultdict(int)
    for w, use in zip(tokens, train):
        for x in [*w, None] if use else []:
            c[x] += 1
    n, v = sum(c.values()), len(c)
    for r, w in zip(got, tokens):
        assert r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(c[x] > 0 for x in [*w, None])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(df, F.lit(False)).count() == 0


def test_depths_that_a_key_has_no_room_for(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for depth in (1, 8):
        with pytest.raises(ValueError):
            lm.score_texts(df, F.lit(False), depth=depth)


def test_names_of_blocks_part_them(spark):
    from cpgspark.llm.common import spread_keys

    for n in (1, 7, 50):
        keys = spread_keys(spark, n)
        df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(n, "k")
        assert len({*keys}) == n and sorted(len(p) for p in df.rdd.glom().collect()) == [1] * n
    assert spread_keys(spark, 5, 4) == [0, 1, 2, 3, 4]
