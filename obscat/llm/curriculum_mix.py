"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight for its whole share and a schedule for how that share
is spread over training time t in [0, 1]: ``w(t) = 1 + slope * (2t - 1)``, whose
integral ``W(t) = (1 - slope) t + slope t**2`` is the source's cumulative demand,
as a fraction of its target.  A document that begins after a fraction f of its
source's words is trained on at the t with W(t) = f, which has a closed form.
Sorting by that position is a range exchange of narrow rows; texts stay where
they are.

Everything here is DataFrame functions.  A running sum over a source is never
one task: a source falls into BUCKETS buckets by its documents' order key, the
buckets' sums are summed first, and each bucket then only sums its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of a source are ordered by a digest of their id and text; its first hex digits are the bucket.
BUCKET_DIGITS = 3
#: No source, and no document, is taken more often.
MOST = 3
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    r"""Number of maximal runs without space, tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, *, most: int = MOST, slopes=SLOPES) -> DataFrame:
    """source, ord, source_size, target, slope for each source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share
    all words; a target stops at most times its source's size and the excess goes
    to the others by weight.  The level at which weights share what capped
    sources leave is found in one pass over the sources, by order of the level at
    which each of them is capped.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("ord", F.row_number().over(everyone) - 1).withColumn("weight", F.col("ord") % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    rising = Window.orderBy("full_at", "ord")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "ord", "level"))).over(total)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("ord") % len(slopes) + 1).cast("int"))
    return s.select("source", "ord", "source_size", target.alias("target"), slope.alias("slope"))


def position(fraction: Column, slope: Column) -> Column:
    """The t in [0, 1] at which a source's demand reaches the fraction."""
    one = 1 - slope
    return F.when(slope == 0, fraction).otherwise((F.sqrt(one * one + 4 * slope * fraction) - one) / (2 * slope))


def curriculum_mix(docs: DataFrame, *, most: int = MOST, slopes=SLOPES, tag: Column | None = None) -> DataFrame:
    """What the mix takes of each row of docs, and when.

    Returns doc_id, source, size, source_size, target, copies, taken, position
    (of the first copy; null where nothing is taken), start (words of the source
    before it) and slope, one row for each input row.  Each source gives whole
    passes over its documents and then, in the order of a digest of their ids and
    texts, words up to its target; the document at the boundary is taken in part.
    A source's taken words are its target, rounded.  Null text has size 0, null
    sources are one source, the last.  Rows of one id, or of none, are spread by
    their texts.  Rows equal in id, source and text are counted before they are
    ordered, so a row that repeats a million times is one row there; they follow
    each other and can stand for each other.  With a tag, rows of other tags are
    other rows, and the tag is returned.  An empty table gives an empty result.
    Columns of docs beside doc_id, source and text do not matter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), order.alias("rank"), (tag if tag is not None else F.lit(0).cast("long")).alias("tag"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "rank", "tag").agg(F.count(F.lit(1)).alias("n")))
    sources = stored(source_targets(rows.withColumn("size", F.col("size") * F.col("n")), most=most, slopes=slopes))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = stored(rows.withColumn("bucket", F.conv(F.substring("rank", 1, BUCKET_DIGITS), 16, 10).cast("int")))
    whole = F.col("size") * F.col("n")
    sums = rows.groupBy("ord", "bucket").agg(F.sum(whole).alias("words"))
    earlier = Window.partitionBy("ord").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("ord", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")))
    rows = rows.join(sums, ["ord", "bucket"])
    inside = Window.partitionBy("ord", "bucket").orderBy("rank", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("first", F.col("base") + F.sum(whole).over(inside) - whole)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("first") + F.col("at") * F.col("size"))
    some = F.col("source_size") > 0
    passes = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.round(F.col("target")).cast("long") - passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), extra - F.col("start")))
    rows = rows.withColumn("taken", passes * F.col("size") + part).withColumn("copies", F.when(F.col("taken") > 0, passes + (part > 0).cast("long")).otherwise(0))
    fraction = F.when(F.col("taken") > 0, F.col("start") / F.col("target"))
    extra_columns = ["tag"] if tag is not None else []
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", position(fraction, F.col("slope")).alias("position"), "start", "slope", *extra_columns)


def training_order(mix: DataFrame, *, ranked: bool = True) -> DataFrame:
    """One row for each copy of each document; if ranked, in training order, a range exchange by position."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    every = mix.filter("copies > 0").select("*", copy)
    fraction = (F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target")
    every = every.withColumn("position", position(fraction, F.col("slope")))
    return every.orderBy("position", "doc_id", "copy") if ranked else every


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row, in training order."""
    return curriculum_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), F.col("doc_id"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS rank
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
  FROM d GROUP BY source),
w AS (SELECT *, ord % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / (ord % 3 + 1) AS full_at FROM s),
l AS (
  SELECT full_at, ord,
         CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY full_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY full_at, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT w.*, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, ord LIMIT 1), 0) * weight) AS target,
         [-0.5::DOUBLE, 0.0, 0.5][ord % 3 + 1] AS slope
  FROM w),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(sum(d.size) OVER (PARTITION BY t.ord ORDER BY d.rank ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, passes * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - passes * source_size - start)) AS taken FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken <= 0 THEN NULL
            WHEN slope = 0 THEN start / target
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target)) - (1 - slope)) / (2 * slope) END AS position
FROM k
"""
