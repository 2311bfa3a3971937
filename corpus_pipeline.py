"""From raw documents to token ids: quality, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a table with the columns of documents, the last one with tokens.

Further columns of docs are passed through, whatever their names, and an empty
table gives an empty table in each stage; the stages say what nulls, empty and
repeated texts become.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgspark.llm.bpe import encode_column
from cpgspark.llm.common import crc_of_id, materialize, table, unused
from cpgspark.llm.decontaminate import decontaminate
from cpgspark.llm.jaccard import near_duplicate_groups
from cpgspark.llm.quality import learn, score_quality

#: Keys of documents (about 50 bytes each) up to this number are broadcast, more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Each whole row as one column, so that no name of it can clash, its id and the digest of its text."""
    tkey = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), tkey.alias("t"))


def _side(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.3 or more).

    Null and empty texts get the score of a text without features, and equal
    texts equal scores, so repeated rows stay or go together.
    """
    model = learn(docs, table(spark, sf_dir, "labels"), F.pmod(crc_of_id(), F.lit(5)) != 0)
    names = unused(docs.columns, "_score", "_predicted")
    return score_quality(docs, model, tuple(docs.columns), names=names).filter(F.col(names[1]) == 1).drop(*names)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of 5-word shingles: that with the smallest id.

    A null id comes after all others, and of equal ids, null or not, the least
    digest of the text decides.  Texts without words are linked with nothing and
    stay.  Of rows equal in id and text one stays.
    """
    groups = near_duplicate_groups(docs, words=5, p=8)
    stay = groups.filter("n_shingles = 0 or least is null or (doc_id <=> least.doc_id and tkey = least.tkey)")
    keys = materialize(stay.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("s")), "keys")
    kept = _keyed(docs).join(_side(keys), (F.col("t") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")))
    once = kept.filter("n = 1 or s = 0").select("row")
    again = kept.filter("n > 1 and s > 0").dropDuplicates(["id", "t"]).select("row")
    return once.unionByName(again).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item.

    Null and empty texts have no words and stay; equal texts stay or go together,
    with null ids too.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(found.filter("contaminated").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct(), "contaminated")
    return _keyed(docs).join(_side(bad), (F.col("t") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")), "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the text that they decode to, in place of its text.

    Null and empty texts have no tokens; repeated rows are encoded each.  A column
    named like a result (n_tokens, ids, decoded) gives way to it.
    """
    keep = tuple(c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded"))
    return encode_column(docs, "text", public_tokenizers.path("word_bpe_49k.json"), keep, digests=False)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontamination", decontamination), ("tokens", tokens)]

#: No stage but the decontamination can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
