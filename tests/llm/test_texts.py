"""Tokens, shards, media, archives, chats: round trips, libraries and brute force."""

import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cpgspark.llm import bpe, chat, count_tokens, shard, textkernel, tiff, warc

ODD = ["", " ", "  a", "a<|endoftext|>b <|startoftext|>", "İstanbul ǅ ẞ", "\x00\x1c a\x85b c", "日本語 テキスト 123", "é café éx", "don't I'LL they'Ve '", "😀😀 a_b", "ΑΣ ΑΣ.", "a​b", "क़ ﬁ", "aaaaaaaa aaa", "a▁b ▁", "x " * 3000, "word\nnext\r\nline\ttab", "z" * 5000]


def rows(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")


def test_word_kernel_equals_split():
    texts = [*ODD, None, "A\tB\x0bC\x0c\rD"]
    offsets, raw = textkernel.text_buffers(pa.array(texts, pa.string()))
    bounds, hashes = textkernel.words_by_row(offsets, raw)
    seen = {}
    for i, t in enumerate(texts):
        words = bytes(t or "", "utf-8").translate(bytes(textkernel._LOWER)).split()
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, h in zip(words, hashes[bounds[i] : bounds[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len({*seen.values()}) == len(seen)


def test_word_longer_than_a_chunk():
    n = textkernel._CHUNK
    raw = np.frombuffer(b"b " + b"a" * (2 * n + 5) + b" c" + b"a" * (2 * n + 5), np.uint8)
    starts, h = textkernel.word_hashes(raw)
    assert len(starts) == 3 and h[1] != h[2]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.encode_column(rows(spark, [*ODD, None]), "text", path, digests=False).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD, ""]):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_runs_of_one_pair():
    b = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    lib = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for n in range(1, 40):
        assert b.encode_words([b"a" * n, b"ha" * n]) == [lib.encode(w * n).ids for w in ("a", "ha")]


def test_piece_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = count_tokens.token_counts(rows(spark, [*ODD, None]), "text", path, limit=100).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD, ""]):
        n = len(lib.encode(t))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 100)


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(kind, big):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 70, 2000)] + [b"\0" * 6400, b"ab" * 3200]
    for predictor in (False, True):
        for tiled in (False, True):
            got = [p.tobytes() for _, p in tiff.read_pages(tiff.encode_tiff(pages, kind, predictor, tiled, strip_rows=100, big=big))]
            assert got == pages


def test_tiff_table(spark):
    texts = [*ODD, None, "z" * 64, *(f"{i} é\t" * (3 * i) for i in range(60)), "ab\n" * 100_000, "ab\n" * 100_000]
    df = rows(spark, texts).withColumns({"media": F.lit(1), "n_text": F.lit("x"), "_text": F.lit("y")})
    out = tiff.tiff_pages(tiff.text_to_tiff(df, "text"), "media", ("doc_id", "n_text")).collect()
    last = {r["doc_id"]: r for r in out if r["last"]}
    assert len(last) == len(texts) and not any(r["error"] for r in out)
    assert {r["compression"] for r in out} == {tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE}
    for i, t in enumerate(texts):
        r, raw = last[i], (t or "").encode()
        n = len(raw)
        raw = raw.ljust(max(64, -(-n // 64) * 64), b"\0")
        assert (r["n_text"], r["so_far_bytes"], r["so_far_sha256"], r["tail_crc32"]) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        mine = [p for p in out if p["doc_id"] == i]
        assert [p["page"] for p in sorted(mine, key=lambda p: p["page"])] == [*range(-(-len(raw) // tiff.PAGE_BYTES))]
        first = np.frombuffer(raw[: tiff.PAGE_BYTES], np.uint8).reshape(-1, 64)
        assert r["so_far_feature"] == f"{tiff.average_hash(first).split('-')[0]}-{sum(raw) * 1000 // len(raw)}"
    assert last[len(texts) - 1]["so_far_feature"] == last[len(texts) - 2]["so_far_feature"]
    assert tiff.tiff_pages(tiff.text_to_tiff(df.limit(0), "text"), "media", ("doc_id",)).count() == 0
    bad = tiff.tiff_pages(spark.createDataFrame([(1, b"no"), (2, None), (3, b"II*\0\xff\0\0\0")], "doc_id long, media binary"), "media", ("doc_id",)).collect()
    assert sorted((r["doc_id"], r["page"]) for r in bad) == [(1, -1), (3, -1)]


def test_average_hash():
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[:, None] * 4, 64, axis=1)
    assert tiff.average_hash(ramp) == f"{'00' * 4 + 'ff' * 4}-{int(ramp.sum()) * 1000 // ramp.size}"
    assert tiff.average_hash(np.full((3, 64), 7, np.uint8)) == f"{'00' * 8}-7000"


def _field(media, tag, value, count=None):
    """The file with another value, or number of values, of a tag in its first directory (little-endian)."""
    out = bytearray(media)
    at = int.from_bytes(media[4:8], "little")
    for k in range(int.from_bytes(media[at : at + 2], "little")):
        e = at + 2 + 12 * k
        if int.from_bytes(media[e : e + 2], "little") == tag:
            if count is not None:
                out[e + 4 : e + 8] = count.to_bytes(4, "little")
            out[e + 8 : e + 12] = value.to_bytes(4, "little")
    return bytes(out)


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_damaged_tiff_is_noticed(kind):
    rng = np.random.default_rng(1)
    good = tiff.encode_tiff([rng.integers(0, 256, 64 * 40, dtype=np.uint8).tobytes()], kind, strip_rows=10)
    damaged = [
        good[:50],
        good[:-3],
        _field(good, 257, 4000),  # a height without strips
        _field(good, 257, 2**31),
        _field(good, 256, 2**31),
        _field(good, 256, 0),
        _field(good, 278, 0),
        _field(good, 278, 5),
        _field(good, 259, 7),
        _field(good, 273, 8, 1),  # one strip of four
        _field(good, 279, 2**31 - 1, 2**31 - 1),  # more entries than the file has bytes
        _field(good, 317, 3),
        b"MM" + good[2:],
    ]
    for media in damaged:
        one, two = (tiff._page_rows(media, 64) for _ in range(2))
        assert one == two and one[-1][0] == -1 and one[-1][-1]


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 100
    data = [(5, "u5", long), (3, "u3", long), (9, "u9", long), (1, "u1", "short"), (2, "u2", "short"), (4, None, None), (None, "u", long), (3, "u3", long), (7, "u\r\nX: 1", "x" * 200_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(warc.mark_revisits(pages))).collect()
    got = sorted((r["page_id"] is not None, r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out)
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        again = i in (5, 9)
        want.append((i is not None, i, "revisit" if again else "response", 3 if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want)
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)))).count() == 0


def test_warc_notices_damage():
    good = warc.record("response", "1", "u", hashlib.sha256(b"abc").hexdigest(), 3, b"abc", None)
    source = pa.BufferReader(good + good)
    assert [p for _, p in warc.read_records(source.read)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        [*warc.read_records(pa.BufferReader(good[:-20]).read)]
    forged = gzip.compress(gzip.decompress(good).replace(b"abc", b"abd"))
    with pytest.raises(warc.DigestError):
        [*warc.read_records(pa.BufferReader(forged).read)]


def test_chat_masks(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "", None, "\n\n  é😀 <|", r"<\|x <\\|y", "%0A", "<|endoftext|>", " a "]
    data = [(c, t, role, x) for c in (1, 2, None) for t, (role, x) in enumerate((r, x) for x in texts for r in ("user", "assistant"))] + [(3, None, None, None), (3, 0, "a\nb%0A", "q"), (3, 0, "assistant", "q"), (3, 0, "assistant", "q")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, None):
        turns = "".join(f"{r}\n{x or ''}\n" for x in texts for r in ("user", "assistant"))
        loss = "".join(x or "" for x in texts)
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (16, sha(turns), len(loss), sha(loss))
    assert got[3]["turns_sha256"] == sha("\n\n" + "a\nb%0A\nq\n" + "assistant\nq\n" * 2)
    assert chat.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_chat_segments_keep_the_encoding(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 50)
    turns = [("user" if i % 2 else "assistant", f" text {i} ") for i in range(40)]
    whole, spans = chat.render(turns)
    model = chat.chat_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [i for k in range(0, 40, 3) for i in model.encode(chat.render(turns[k : k + 3])[0], add_special_tokens=False).ids]
    assert parts == model.encode(whole, add_special_tokens=False).ids
    e = model.encode(whole, add_special_tokens=False)
    loss, cut = chat.mask(np.array(e.offsets), spans)
    assert cut == spans and loss.sum() < len(loss)
    assert chat.parse(whole) == turns


def shards_of(out, n):
    total = out.groupby("shard")["size"].sum()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == [*range(len(g))]
    assert {*out["shard"]} <= {*range(n)}
    return total


def test_shards_are_balanced_and_gapless(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), int(s)) for i, s in enumerate(rng.integers(1, 1000, 3000))] + [(None, 5)] * 3 + [(7, 1)] * 500
    df = spark.createDataFrame(data, "doc_id long, size long").withColumns({c: F.lit("x") for c in ("before", "index", "_part", "_bytes", "_rows", "_first", "_before", "_index")})
    out = shard.shard_by_bytes(df, "size", ["doc_id", "size"], 16)
    assert out.columns == [*df.columns, "shard", "slot"]
    out = out.toPandas()
    total = shards_of(out, 16)
    assert len(out) == len(data) and len(total) == 16 and total.max() - total.min() <= 2 * 1000
    ends = out[out.doc_id.notna()].groupby("shard")["doc_id"].agg(["min", "max"]).sort_index()
    assert (ends["max"].values[:-1] <= ends["min"].values[1:]).all()
    assert shard.shard_by_bytes(df.limit(0), "size", ["doc_id", "size"]).count() == 0
    assert shard.shard_by_bytes(df.limit(1), "size", ["doc_id", "size"]).collect()[0]["slot"] == 0


def test_groups_stay_in_one_shard_unless_they_are_large(spark):
    rng = np.random.default_rng(2)
    data = [(f"g{g}", int(rng.integers(1e6)), 1 + g % 7) for g in range(2000) for _ in range(1 + g % 5)] + [("hot", i, 10) for i in range(3000)] + [(None, 1, 1)] * 20
    df = spark.createDataFrame(data, "key string, doc_id long, size long")
    out = shard.shard_by_bytes(df, "size", ["key", "doc_id"], 8, ["key"]).toPandas()
    total, target = shards_of(out, 8), sum(d[2] for d in data) / 8
    assert (abs(total - target) <= target / shard.SPLIT + 10).all()
    parted = out.groupby("key", dropna=False)["shard"].nunique()
    assert [*parted[parted > 1].index] == ["hot"]
    with pytest.raises(ValueError):
        shard.shard_by_bytes(df, "size", ["doc_id"], 8, ["key"])


def test_odd_tables_of_tokens(spark):
    """Empty tables, repeated rows and clashing names, for both encoders."""
    df = rows(spark, ["a b", "a b", None]).withColumns({"ids": F.lit("x"), "n_bytes": F.lit("y"), "_text": F.lit("z"), "t": F.lit(0)})
    df = df.unionByName(df)
    ids = bpe.encode_column(df, "text", public_tokenizers.path("word_bpe_49k.json"), digests=False)
    counts = count_tokens.token_counts(df, "text", public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(r["n_tokens"] for r in ids.collect()) == [0, 0, 2, 2, 2, 2]
    assert sorted(r["n_tokens"] for r in counts.collect()) == [0, 0, 2, 2, 2, 2]
    for f, path in ((bpe.encode_column, "word_bpe_49k.json"), (count_tokens.token_counts, "piece_bpe_32k.model")):
        assert f(df.limit(0), "text", public_tokenizers.path(path)).count() == 0
