"""The corpus pipeline: documents through five operators, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; all but the last return the columns of documents.  Executors begin each
stage without what the one before it made their Java heaps grow to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm import curriculum_mix, exact_fingerprint, partenum_join, rank_bpe, subword_quality
from obscat.llm.common import ascii_lower, let_go, passing, shards, shrink, stored, table
from obscat.llm.rows import same_row, without

#: Near duplicates: shingles of five words, Jaccard similarity of at least 0.8.
NEAR_WORDS, NEAR_SIMILAR = 5, (80, 100)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is trained on labels."""
    shrink(spark)
    return subword_quality.keep_good(docs, subword_quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the greatest id; a repeated row stays once."""
    shrink(spark)
    with passing(spark) as keep:
        found = exact_fingerprint.exact_dedup(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
        found = found.agg(F.max("kept").alias("once"), F.count(F.lit(1)).alias("n"))
        decided = keep(stored(found.filter("NOT once OR n > 1").drop("n")))
    return without(docs, decided, lambda text: F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate links: the smallest id, null ids last, and of equal ids the least digest."""
    shrink(spark)
    with passing(spark) as keep:
        found = partenum_join.similar_documents(docs, n=NEAR_WORDS, similar=NEAR_SIMILAR).filter("label IS NOT NULL")
        members = stored(found.groupBy("label", F.col("doc_id").alias("id"), F.col("text_hash").alias("digest")).agg(F.count(F.lit(1)).alias("n")))
        place = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
        first = stored(members.groupBy("label").agg(F.min(place).alias("stays"), F.sum("n").alias("rows")).filter("rows > 1").select("label", "stays"))
        decided = members.join(first, "label").select("id", "digest", "n", place.eqNullSafe(F.col("stays")).alias("once"))
        decided = keep(stored(decided.filter("NOT once OR n > 1").drop("n")))
    return without(docs, decided, F.xxhash64)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each copy, range-sorted by training position.

    Rows are told apart by id and a digest of all their columns; rows equal in both
    are one row that is taken for all of them.  Positions fill [0, 1] evenly, so
    their ranges need no sampling.
    """
    shrink(spark)
    digest = F.xxhash64(*(docs[f"`{c}`"] for c in docs.columns))
    with passing(spark) as keep:
        mix = stored(curriculum_mix.curriculum_mix(docs, tag=digest))
        order = curriculum_mix.training_order(mix, ranked=False).select(F.col("doc_id").alias("id"), F.col("tag").alias("digest"), "position", "copy")
        order = keep(stored(order))
        many = keep(stored(mix.groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    if many.limit(1).count():
        once = rows.join(many, same_row(rows, many), "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row"))
        rows = rows.join(many, same_row(rows, many), "left_anti").unionByName(once)
    parts = shards(spark)
    placed = rows.join(order, same_row(rows, order)).select("row", order["id"], "position", "copy")
    part = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("position", "id", "copy").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    shrink(spark)
    return rank_bpe.bpe_digests(docs, rank_bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: The learned classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each result is written before the next stage reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with passing(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir)))
        if before is not None:
            let_go(before)
        before = docs
    return docs
