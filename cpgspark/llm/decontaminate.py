"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Tokens are shingles of three words.  One pass over the documents keeps the
places of those shingles that some benchmark item has; from these places come
the shingles' frequencies in the whole corpus.  A window of an item is contained
in a document only if its rarest shingle is, so one shingle per window - the
necessary prefix at full containment - is joined.  Length and position bound the
candidates (the window must fit between the document's first and last word), and
the window's other shingles are then looked up at their exact places, which
verifies all its words.

The shuffles carry places of benchmark shingles, never texts.  The table of
benchmark shingles is broadcast only when its counted rows are below
`BROADCAST_ROWS`; beyond that the same join is shuffled.

Defined cases: a null text has no words; rows of equal id and text have equal
results, and a null id is an id like another; an item without words hits
nothing; an item without an id hits words but isn't listed; other columns of
both tables are ignored; a very long text is one row's array of words; without
items nothing is hit, and without documents the result is empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, WIDTH = 10, 3
#: About 100 bytes a row: 50 MB at most.
BROADCAST_ROWS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), "")


def _tail(words: str, k: int) -> Column:
    return F.slice(F.col(words), F.lit(k + 1), F.greatest(F.size(words), F.lit(1)))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct item, len, words and wid (the hash of the words) of all windows."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    w = w.withColumn("len", F.least(F.lit(window), F.col("n"))).select("item", "len", "words", F.explode(F.expr("sequence(0, n - len)")).alias("at"))
    return w.select("item", "len", F.expr("slice(words, at + 1, len)").alias("words")).distinct().withColumn("wid", F.xxhash64(F.concat_ws(" ", "words")))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, classes).

    rows: doc_id, key (digest of the text) and n_words of every document row;
    hits: doc_id, key, start, len and cid of every verified occurrence; classes:
    cid and item.  Windows of the same items are one class, so that a window of
    many items costs a document one row until its items are listed once.
    """
    occurring = materialize(item_windows(items, item_id, item_text, window), "occurring")
    hashed = [F.count("item"), F.sum(F.xxhash64("item").cast("decimal(20,0)")), F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(1))))]
    windows = occurring.groupBy("words", "len", "wid").agg(*(c.alias(f"c{i}") for i, c in enumerate(hashed)))
    windows = materialize(windows.select("words", "len", "wid", F.xxhash64("c0", F.col("c1").cast("string"), "c2").alias("cid")), "windows")
    of_class = windows.groupBy("cid").agg(F.min("wid").alias("wid"))
    classes = occurring.filter("item is not null").join(of_class, "wid").select("cid", "item").distinct()
    # tokens of a window: shingles of `WIDTH` words, or all its words where it has fewer
    tokens = windows.select("wid", "len", "words", F.least(F.lit(WIDTH), F.col("len")).alias("width"))
    tokens = tokens.select("wid", "len", "width", "words", F.explode(F.expr("sequence(0, len - width)")).alias("offset"))
    tokens = tokens.select("wid", "len", "width", "offset", F.expr("slice(words, offset + 1, width)").alias("t"))
    tokens = materialize(tokens.withColumn("sid", F.xxhash64(F.concat_ws(" ", "t"), "width")), "tokens")
    known = tokens.select("width", "t", "sid").distinct()
    counts = {r["width"]: r["n"] for r in known.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most WIDTH rows

    body = F.coalesce(F.col(text), F.lit(""))
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("key"), words_of(F.col(text)).alias("w"))
    seen = seen.select("doc_id", "key", F.size("w").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a0"), *(_tail("w", k).alias(f"a{k}") for k in range(1, WIDTH)))).alias("pos", "z"))
    seen = seen.select("doc_id", "key", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), *(F.col(f"z.a{k}").alias(f"a{k}") for k in range(WIDTH)))
    found = []
    for width in range(1, WIDTH + 1):
        if not counts.get(width):
            continue
        side = known.filter(F.col("width") == width).select(*(F.col("t")[k].alias(f"t{width}{k}") for k in range(width)), F.col("sid").alias(f"sid{width}"))
        hashed = F.xxhash64(*(f"t{width}{k}" for k in range(width)))
        side = side.withColumn(f"h{width}", hashed)
        if counts[width] <= BROADCAST_ROWS:
            side = F.broadcast(side)
        same = F.xxhash64(*(f"a{k}" for k in range(width))) == F.col(f"h{width}")
        for k in range(width):
            same = same & (F.col(f"a{k}") == F.col(f"t{width}{k}"))
        seen = seen.join(side, same, "left")
        found.append(f"sid{width}")
    sids = F.array_compact(F.array(*(F.col(c) for c in found))) if found else F.array().cast("array<bigint>")
    places = materialize(seen.select("doc_id", "key", "n_words", "pos", sids.alias("sids")).filter((F.size("sids") > 0) | (F.col("pos") == 0)), "places")

    rows = places.filter("pos = 0").select("doc_id", "key", "n_words")
    # identical rows count once; the sum before the shuffle brings copies within a task together
    at = places.filter(F.size("sids") > 0).select("doc_id", "key", "n_words", "pos", F.explode("sids").alias("sid")).distinct()
    often = at.groupBy("sid").agg(F.count(F.lit(1)).alias("df"))
    # windows of which some shingle is nowhere in the corpus are out; of the others, the rarest shingle
    ranked = tokens.join(often, "sid", "left").groupBy("wid", "len", "width").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sid", "offset")).alias("first"))
    prefix = ranked.filter("least > 0").select("wid", "len", "width", F.col("first.sid").alias("sid"), F.col("first.offset").alias("offset"))
    small = sum(counts.values()) <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda x: x)
    candidates = at.join(near(prefix), "sid").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0 and start + len <= n_words")
    candidates = candidates.select("doc_id", "key", "start", "wid", "len", "width")
    # shingles that together cover the window: every WIDTH-th, and the last
    cover = tokens.filter("offset % width = 0 or offset = len - width").groupBy("wid").agg(F.collect_list(F.struct("offset", "sid")).alias("cover"))
    wanted = candidates.join(near(cover), "wid").select("doc_id", "key", "start", "wid", "len", F.size("cover").alias("need"), F.explode("cover").alias("c"))
    wanted = wanted.select("doc_id", "key", "start", "wid", "len", "need", (F.col("start") + F.col("c.offset")).alias("pos"), F.col("c.sid").alias("sid"))
    there = at.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("pos").alias("p"), F.col("sid").alias("s"))
    met = wanted.join(there, (F.col("key") == F.col("k")) & (F.col("pos") == F.col("p")) & (F.col("sid") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
    hits = met.groupBy("doc_id", "key", "start", "wid", "len", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    hits = hits.join(near(windows.select("wid", "cid")), "wid").select("doc_id", "key", "start", "len", "cid")
    return rows, hits, classes


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated of every document row."""
    rows, hits, classes = contamination(docs, items, **names)
    hits = materialize(hits, "hits")
    words = hits.select("doc_id", "key", F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("doc_id", "key", "cid").distinct().join(classes, "cid").select("doc_id", "key", "item").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))).cast("binary"), 256).alias("items_sha256"))
    both = words.withColumnsRenamed({"doc_id": "d", "key": "k"}).join(named.withColumnsRenamed({"doc_id": "e", "key": "l"}), (F.col("k") == F.col("l")) & F.col("d").eqNullSafe(F.col("e")), "left").select("d", "k", "n_hit", "n_items", "items_sha256")
    out = rows.join(both, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select(
        "doc_id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    from .common import table

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s, w FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM bw
), lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n
), hit AS (
  SELECT doc_id, s, win.n, item_id FROM (SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM dw) x JOIN win ON x.t = win.t AND x.n = win.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""
