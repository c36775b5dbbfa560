"""Quality classifier with supervised subword embeddings.

Every word and every character n-gram of a text hashes to a row of a learned
embedding table; a document is the mean of its rows, a linear layer and a
softmax give the class.  Training is stochastic gradient descent in numpy on the
driver, over a bounded sample of labelled rows whose hashed feature counts are
computed on the executors.  The mean and the last layer are linear, so for
scoring each bucket's vector folds into one number and a document's logit is the
mean of its buckets' numbers: whole texts are scored with one table of
BUCKETS floats, broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, _IS_SPACE, batch, crc_mod5, frugal, pieces, slabs, texts, words

BITS = 16
BUCKETS = 1 << BITS
#: Labelled rows of each class that training looks at, at most: the bound of the sample.
SAMPLE_PER_CLASS = 1500
THRESHOLD = 0.3
#: Neutral features that every text has beside its own, so that a few words decide little.
NEUTRAL = 8
#: Feature arrays of a slab of text stay within a few tens of MB.
SLAB = 1 << 19

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_DOWN = np.uint32(32 - BITS)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place of each one's first byte; of bytes that are no UTF-8 each is a character."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:
        return data.astype(np.uint32), np.arange(len(data))
    return points, np.flatnonzero((data & 0xC0) != 0x80)


def features(data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of a slab's features: words, word pairs, and n-grams of 3 and 5 characters.

    An n-gram may begin or end at a space, which marks a word's edge, but has none
    inside.  A pair hashes to the exclusive or of its words' hashes, so that a word
    that is repeated at once is one and the same feature, whatever the word.
    """
    rows = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    starts, _, hashes = words(data)
    first = rows[starts]
    out = [(first, (hashes >> np.uint64(64 - BITS)).astype(np.uint32))]
    pairs = MULT * (hashes[1:] ^ hashes[:-1])[first[1:] == first[:-1]]
    out.append((first[:-1][first[1:] == first[:-1]], (pairs >> np.uint64(64 - BITS)).astype(np.uint32)))
    points, place = characters(data)
    space, rows, n = _IS_SPACE[data[place]], rows[place], len(points)
    if n >= 3:
        three = points[:-2] * _A ^ points[1:-1] * _B ^ points[2:] * _C
        at = np.flatnonzero(~space[1:-1] & (rows[2:] == rows[:-2]))
        out.append((rows[at], (three[at] * _A) >> _DOWN))
        if n >= 5:
            at = np.flatnonzero(~(space[1:-3] | space[2:-2] | space[3:-1]) & (rows[4:] == rows[:-4]))
            five = three[at] * _B ^ (points[at + 3] * _C + points[at + 4]) * _A
            out.append((rows[at], (five * _A) >> _DOWN))
    return out


@dataclass(frozen=True)
class SubwordModel:
    """weight[b]: the bucket's vector times the difference of the two output rows."""

    weight: np.ndarray
    bias: float

    def scores(self, rows: list[bytes]) -> np.ndarray:
        """Probability of the good class for each text."""
        out = np.zeros(len(rows))
        for first, last, data, ends in slabs(rows, SLAB):
            total, count = np.zeros(last - first), np.zeros(last - first)
            for row, bucket in features(data, ends):
                total += np.bincount(row, self.weight[bucket], last - first)
                count += np.bincount(row, minlength=last - first)
            out[first:last] = total / (count + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def sample_features(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label, buckets and their counts for a bounded sample, in an order that does not change.

    Rows without label, and those of the held-out fifth, are never in it.  Where
    an id has several labels the mean decides, where it has several texts the least.
    The sample takes per_class ids of each class, those of the least digests.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().filter(crc_mod5(F.col("doc_id")) != 0)
    ids = ids.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).withColumn("rank", F.md5(F.col("doc_id").cast("string").cast("binary")))
    ids = [ids.filter(F.col("label") == k).orderBy("rank", "doc_id").limit(per_class) for k in (0, 1)]
    wanted = F.broadcast(ids[0].unionByName(ids[1]).select("doc_id", "label", "rank"))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    # of rows that share an id one is taken, so the sample is bounded before it is sent to the driver
    rows = rows.groupBy("doc_id", "rank", "label").agg(F.min("text").alias("text")).select("rank", "label", "text")
    schema = pa.schema([("rank", pa.string()), ("label", pa.int32()), ("bucket", pa.binary()), ("count", pa.binary())])

    def run(batches):
        for b in batches:
            out = []
            for text in texts(b.column(2)):
                seen = np.zeros(BUCKETS, np.int64)
                for _, _, data, ends in slabs([text], SLAB):
                    for _, bucket in features(data, ends):
                        seen += np.bincount(bucket, minlength=BUCKETS)
                used = np.flatnonzero(seen)
                out.append((used.astype("<u2").tobytes(), seen[used].astype("<f4").tobytes()))
            yield batch(schema, b.column(0), b.column(1), [o[0] for o in out], [o[1] for o in out])

    found = rows.mapInArrow(frugal(run), "rank string, label int, bucket binary, count binary").toArrow().to_pylist()
    found.sort(key=lambda r: r["rank"])
    return [(r["label"], np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["count"], "<f4")) for r in found]


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], *, dim: int = 8, epochs: int = 12, rate: float = 0.6, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent on the embeddings and the softmax layer, one document a step.

    Both classes weigh alike in the loss, then the bias takes the sample's own
    share of classes into account.  Without rows of both classes every score is
    the share of the good class (1 without any label).
    """
    share = np.mean([y for y, _, _ in sample]) if sample else 1.0
    if share in (0.0, 1.0):
        return SubwordModel(np.zeros(BUCKETS, np.float32), 30.0 if share == 1.0 else -30.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = 0.5 / np.array([1 - share, share])
    docs = [(y, b, c / (c.sum() + np.float32(NEUTRAL))) for y, b, c in sample if len(b)]
    steps = epochs * len(docs)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            y, bucket, part = docs[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = part @ table[bucket]
            logit = layer @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            p *= np.float32(min(weight[y], 4.0))
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            bias -= np.float32(0.1) * lr * p
            # counts are averaged, so a bucket's step is its share of the text times the width of a mean text's support
            table[bucket] -= lr * 30 * np.outer(part, back)
    return SubwordModel((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS) -> SubwordModel:
    return train(sample_features(docs, labels, per_class=per_class))


def score(docs: DataFrame, model: SubwordModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text is empty, a null id never held out.

    Only the text is an input of the score.  Empty texts get the score of a
    document without features.  Repeated rows are each scored; an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in (p for b in batches for p in pieces(b, 1)):
            yield batch(schema, b.column(0), sent.value.scores(texts(b.column(1))))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), "doc_id long, score double")
    held = F.coalesce(crc_mod5(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: SubwordModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns, whatever their names.

    A null or empty text gets the score of a document without features.  Repeated
    rows all stay or all go; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            both = pa.RecordBatch.from_arrays([b.column(0).field(at), b.column(0)], names=["text", "row"])
            for p in pieces(both, 0):
                keep = sent.value.scores(texts(p.column(0))) >= threshold
                yield p.select(["row"]).filter(pa.array(keep))

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(frugal(run), rows.schema).select("row.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by a model fitted on labels outside the held-out fifth.

    Nulls, empty texts, repeated rows and empty tables are as for score; without
    labels of both classes all scores are alike.
    """
    return score(docs, fit(docs, labels))
