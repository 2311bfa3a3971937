"""Near copies, benchmark passages, quality and the pipeline against brute force."""

import math
import os
import random
import re
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cpgspark.llm import decontaminate as dc
from cpgspark.llm import jaccard, quality
from cpgspark.llm.queries import QUERIES, SQL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def shingles(text, k):
    w = words(text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, p, q):
    sets = [shingles(t, k) for _, t in rows]
    up = [*range(len(rows))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and q * both >= p * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [r for x, (r, _) in enumerate(rows) if root(x) == root(i) and r is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def corpus(seed, n_groups=12):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    line = " ".join(rng.choice(vocab) for _ in range(12))
    texts = ["", None, " \n", "one", "ONE", "two words", "Two\twords", "a b c", "a b c d"]
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.choice((8, 30, 90, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append((line + "\n" if rng.random() < 0.3 else "") + " ".join(copy))
    rows = [*enumerate(texts)]
    return rows + [(None, texts[-1]), (None, texts[12]), rows[-1], rows[-1], (10_000, "x" * 50_000)]


@pytest.mark.parametrize("k,p", [(3, 9), (5, 8)])
def test_components_equal_brute_force(spark, k, p):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"region": F.lit("r"), "f1": F.lit(1)})
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, words=k, p=p).collect()), key=str)
    assert got == sorted(brute_components(rows, k, p, 10), key=str)


def test_components_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_large_pieces_by_pivots_and_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "TASK_DOCS", 3)
    monkeypatch.setattr(jaccard, "REGION_ROWS", 7)
    rng = random.Random(seed)
    rows = corpus(seed, 6)
    for n, edits in ((200, 6), (60, 3), (2500, 90)):  # chains of copies, of which few link with the first
        text = [f"c{seed}w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(25):
            rows.append((100 + len(rows), " ".join(text)))
            for _ in range(edits):
                text[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_components(rows, 3, 9, 10), key=str)


def test_counts_never_part_more_than_the_sets():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 5, 800, 1024, 1025, 1200, 5000, 9000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate((base[: n - n // 20], rng.integers(0, 2**63, n // 20).astype(np.uint64))))]
    v = jaccard._Vectors(pa.array([jaccard._counts(s) for s in sets], pa.binary()))
    i, j = np.triu_indices(len(sets), 1)
    for a, b, d in zip(i, j, v.apart(i, j)):
        assert d <= len(np.setxor1d(sets[a], sets[b]))
        far = abs(len(sets[a]) - len(sets[b])) * 10 > len(sets[b]) or (b - a > 1 or a % 2)
        if far and len(sets[a]) > 2000:
            assert d > 2 * (len(sets[a]) + len(sets[b])) / 18


def test_joined_side_and_two_sides_of_a_region():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 100 - e], rng.integers(0, 2**63, e).astype(np.uint64)))) for e in (0, 1, 2, 3, 60)]
    t = jaccard.Threshold(8, 10)
    assert len(jaccard.join_region(sets, t)) == 3
    assert len(jaccard.join_region(sets, t, np.array([1, 1, 1, 0, 0]), True)) == 1
    assert len(jaccard.join_region(sets, t, np.array([1, 1, 0, 0, 0]))) == 3


def test_recursive_region_join_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    rng = np.random.default_rng(3)
    t = jaccard.Threshold(8, 10)
    sets = []
    for g in range(30):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(6):
            s = base.copy()
            s[rng.integers(0, 60, 4)] = rng.integers(0, 2**63, 4).astype(np.uint64)
            sets.append(np.unique(s))
    up = jaccard._Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                up.join(i, j)
    have = jaccard._Forest(len(sets))
    for i, j in jaccard.join_region(sets, t):
        have.join(i, j)
    assert [up.root(i) for i in range(len(sets))] == [have.root(i) for i in range(len(sets))]


def brute_contamination(docs, items, window=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))

    wins = []
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        wins += [(i, w[s : s + n]) for s in range(len(w) - n + 1)] if w else []
    out = []
    for d, t in docs:
        w = split(t)
        hit, named = set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= {*range(s, s + len(x))}
                    named.add(i)
        out.append((d, len(w), len(hit), len(named - {None}), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "a", "été", "x9", "mat", "cat", "ß"]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    items = [(1, passage), (2, "the cat"), (3, "zebra"), (4, ""), (5, None), (6, " ".join(passage.split()[5:20]) + " end"), (None, "mat mat mat"), (7, "the of a the of a the of a the of a")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(50, "go " + passage.upper().replace(" ", ", ") + " x"), (51, " ".join(passage.split()[:9])), (52, None), (53, "Zebra"), (None, passage), (50, passage), (50, passage), (54, "é" * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pos": F.lit(1), "key": F.lit("k")})
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute_contamination(docs, items)


def test_contamination_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in dc.decontaminate(d, i).collect()] == [False]
    assert dc.decontaminate(d.limit(0), i).count() == 0


def test_quality_on_held_out_rows(spark, data):
    r = QUERIES["op10_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.3)).all()
    good, bad = r[r.held_out & (r.quality == 1)].score, r[r.held_out & (r.quality == 0)].score
    assert len(good) and len(bad) or data.endswith("0.001")
    if len(good) and len(bad):
        assert (good.values[:, None] > bad.values[None, :]).mean() > 0.85


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, None), (None, ""), (3, "b")], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, quality.learn(docs, none, F.lit(True))).collect()
    assert [r["score"] for r in out] == [0.5] * 4
    both = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    m = quality.learn(docs, both, F.lit(True))
    assert len(quality.score_quality(docs.limit(0), m).collect()) == 0 and quality.score_quality(docs, m).count() == 4


def brute_trigrams(text):
    raw = b"\xff" + (text or "").encode() + (b"\xff" if text else b"")
    keys = [(raw[i - 1] << 8 | raw[i - 2]) << 8 | raw[i] for i in range(2, len(raw))]
    return {int(x) >> 64 - quality.BITS for x in quality.mix(np.array(keys, np.uint64))}


def test_trigrams_and_class_ratios_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "ab", "é", "x" * 9000] + [" ".join(rng.choice(["good", "fine", "bad", "spam", "buy"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    found = [set(x.tolist()) for x in quality.trigram_sets(pa.array(texts, pa.string()))]
    assert found == [brute_trigrams(t) for t in texts]
    label = {i: int("good" in (t or "")) for i, t in enumerate(texts) if i % 3}
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string").withColumns({"y": F.lit(5), "h": F.lit("x"), "id": F.lit(1)})
    m = quality.learn(docs, spark.createDataFrame([*label.items()], "doc_id long, quality int"), F.col("doc_id") < 50)
    counts = np.ones((2, 1 << quality.BITS))
    for i, t in [*enumerate(texts), (7, texts[7])]:
        if i in label and i < 50:
            counts[label[i], list(brute_trigrams(t))] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(m.ratio2, ratio**2)
    shown = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, m).collect()}
    for i, t in enumerate(texts):
        at = sorted(brute_trigrams(t))
        n = math.sqrt((ratio[at] ** 2).sum())
        margin = m.weight[at].sum() / n + m.bias if n else m.bias
        assert shown[i] == pytest.approx(1 / (1 + math.exp(-m.slope * margin - m.shift)))


def test_fit_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 7}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    sizes = []
    keep = quality.dual_coordinate_descent
    quality.dual_coordinate_descent = lambda rows, *a, **k: sizes.append(len(rows)) or keep(rows, *a, **k)
    try:
        quality.learn(docs, labels, F.lit(True), fit_rows=50)
    finally:
        quality.dual_coordinate_descent = keep
    assert sizes and sizes[0] <= 50


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) * (rng.random((60, 6)) < 0.5)
    y = np.where(x[:, 0] + 0.7 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w, b = quality.dual_coordinate_descent(rows, y, 6, epochs=3000)
    wide = np.column_stack((x, np.ones(60)))
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (wide @ v)).sum()
    a = np.zeros(60)  # the dual by projected gradient, a bound from below
    q = (wide * y[:, None]) @ (wide * y[:, None]).T
    for _ in range(20_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, 1)
    assert loss(np.append(w, b)) == pytest.approx(a.sum() - 0.5 * a @ q @ a, rel=1e-3)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [(np.array([0 if s > 0 else 1, 2 + int(rng.integers(8))]), np.array([0.7, 0.7])) for s in y]
    w, b = quality.dual_coordinate_descent(rows, y, 10)
    assert all((w[a] @ v + b) * s > 0 for (a, v), s in zip(rows, y))


@pytest.mark.parametrize("name", [*SQL])
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, data)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(tuple(r) for r in got.select(order).collect()) == plain([v[i] for i in at] for v in want.fetchall())


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    step = docs
    kept = [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.materialize(stage(spark, step, data), name)
        kept.append({r[0] for r in step.select("doc_id").collect()})
        assert kept[-1] <= kept[-2] and (name == "tokens" or step.columns == docs.columns)
    texts = dict(docs.select("doc_id", "text").collect())
    comps = brute_components([(d, texts[d]) for d in sorted(kept[1])], 5, 8, 10)
    assert kept[2] == {d for d, n, c in comps if not n or d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert kept[3] == {d for d, *_, bad in brute_contamination([(d, texts[d]) for d in sorted(kept[2])], items) if not bad}
    assert {r[0] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == kept[4] == kept[3]


def test_pipeline_stages_of_nothing_and_of_odd_rows(spark, data):
    import corpus_pipeline

    benchmark = spark.read.parquet(f"{data}/benchmark.parquet").select("text").first()[0]
    rows = [(1, "plain words"), (1, "plain words"), (None, None), (2, ""), (None, "plain words"), (3, benchmark), (None, benchmark)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({"ids": F.lit("mine"), "_score": F.lit(0), "_t": F.lit(1), "key": F.lit("k"), "component_id": F.lit(9), "_text": F.lit("z")})
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), data)
        assert none.count() == 0 and (name == "tokens" or none.columns == df.columns)
    scored = corpus_pipeline.quality(spark, df, data).collect()
    assert len([r for r in scored if r["text"] == "plain words"]) in (0, 3)
    clean = corpus_pipeline.decontamination(spark, df, data).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean if r["doc_id"]) == [(1, "plain words")] * 2 + [(2, "")] and len(clean) == 5
    done = corpus_pipeline.tokens(spark, df, data).collect()
    assert len(done) == len(rows) and all(r["key"] == "k" and isinstance(r["ids"], list) and (r["n_tokens"] > 0) == bool(r["decoded"]) for r in done)


def test_pipeline_keeps_one_of_repeated_rows(spark, data):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (2, long), (3, ""), (3, ""), (4, None), (None, long + " x"), (None, "other words entirely here now")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_score", F.lit(1))
    got = sorted((r["doc_id"], r["text"] is None) for r in corpus_pipeline.near_duplicate(spark, df, data).collect() if r["doc_id"] is not None)
    assert got == [(1, False), (3, False), (3, False), (4, True)]


def test_pipeline_keeps_one_of_a_group_without_ids_or_with_one_id(spark, data):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, a), (None, a + " x"), (None, a + " y"), (7, b), (7, b + " x"), (None, b + " y"), (None, c), (None, c), (None, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"][:1]) for r in corpus_pipeline.near_duplicate(spark, df, data).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (7, "b"), (None, "c"), (None, "")], key=str)


def test_no_operator_swallows_import_errors():
    folder = os.path.dirname(jaccard.__file__)
    for name in os.listdir(folder):
        if name.endswith(".py"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                assert "ImportError" not in f.read()
