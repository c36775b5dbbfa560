"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial at two bases, each
modulo a 31-bit prime.  Fixed-size chunks are hashed independently of each
other, all full chunks of a text in one matrix product, and combine by
``H(AB) = H(A) * base**len(B) + H(B)``, so a huge text needs no sequential pass.
Equal fingerprints of equal length are then confirmed chunk by chunk: for each
chunk number of a fingerprint only the least and the greatest chunk travel, and they
must be equal.  Where they are not, the group is parted by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, batch, frugal, key_filter, let_go, stored, texts

CHUNK = 1 << 16
#: (prime, base); products of 24 bits of place value and a byte stay below 2**63.
MODULI = ((2147483647, 1000003), (2147483629, 998244341))


class Fingerprinter:
    def __init__(self, chunk: int = CHUNK, moduli=MODULI):
        self.chunk, self.moduli = chunk, moduli
        self.weights = []
        for prime, base in moduli:
            w = [1]
            for _ in range(chunk):
                w.append(w[-1] * base % prime)
            self.weights.append(np.array(w[::-1], np.uint64))  # weights[-1] is base**0, weights[0] base**chunk

    def chunk_hashes(self, data: bytes) -> Iterator[tuple[tuple[int, ...], int]]:
        """Hash at each modulus, and length, of each chunk in order; one chunk's numbers are held at a time."""
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, len(whole), self.chunk):
            values = whole[at : at + self.chunk].astype(np.uint64) + np.uint64(1)
            n = len(values)
            yield tuple(int(values @ w[-n:]) % prime for (prime, _), w in zip(self.moduli, self.weights)), n

    def combine(self, parts: list[tuple[int, int]], which: int) -> int:
        prime, base = self.moduli[which]
        value = 0
        for h, n in parts:
            value = (value * (int(self.weights[which][0]) if n == self.chunk else pow(base, n, prime)) + h) % prime
        return value

    def of(self, data: bytes) -> int:
        """62 bits; texts of different length may still share them."""
        chunks = [*self.chunk_hashes(data)]
        a, b = (self.combine([(h[k], n) for h, n in chunks], k) for k in (0, 1))
        return a << 31 | b

    def key(self, data: bytes) -> int:
        """Fingerprint and length in one signed 64-bit word."""
        x = (self.of(data) * 0x9E3779B97F4A7C15 ^ len(data) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
        return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, chunk: int = CHUNK, moduli=MODULI) -> DataFrame:
    """doc_id, key, n_bytes, sha of every row's text (ASCII-lowered; null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string())])

    def run(batches):
        fp = Fingerprinter(chunk, moduli)
        for b in batches:
            rows = [t.lower() for t in texts(b.column(1))]
            yield batch(schema, b.column(0), [fp.key(t) for t in rows], [len(t) for t in rows], [hashlib.sha256(t).hexdigest() for t in rows])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), "doc_id long, key long, n_bytes long, sha string")


def chunk_extremes(docs: DataFrame, wanted: KeyFilter, *, chunk: int = CHUNK, moduli=MODULI) -> DataFrame:
    """Least and greatest chunk for each (key, n_bytes, chunk_no) of rows that wanted lets pass."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast((wanted.bits, wanted.data))

    def run(batches):
        fp, keep = Fingerprinter(chunk, moduli), KeyFilter(*sent.value)
        for b in batches:
            rows = [t.lower() for t in texts(b.column(0))]
            keys = [fp.key(t) for t in rows]
            seen, out = {}, []
            for i in np.flatnonzero(keep.may_have(np.array(keys, np.int64).view(np.uint64))):
                for no in range(max(1, -(-len(rows[i]) // chunk))):
                    piece, place = rows[i][no * chunk : (no + 1) * chunk], (keys[i], len(rows[i]), no)
                    if seen.setdefault(place, piece) != piece or seen[place] is piece:
                        out.append((*place, piece))
            yield batch(schema, *([list(c) for c in zip(*out)] if out else ([], [], [], [])))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(frugal(run), "key long, n_bytes long, chunk_no long, data binary")
    return rows.groupBy("key", "n_bytes", "chunk_no").agg(F.min("data").alias("least"), F.max("data").alias("greatest"))


def exact_dedup(docs: DataFrame, *, chunk: int = CHUNK, moduli=MODULI) -> DataFrame:
    """Every row of docs with the row that stays in its stead.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input
    row.  The greatest doc_id of equal texts stays; null ids are less than all
    others.  Of repeated rows (same id, equal text) exactly one is kept.  Other
    columns of docs, whatever their names, are not looked at.  An empty table
    gives an empty result.
    """
    rows = first = stored(fingerprints(docs, chunk=chunk, moduli=moduli))
    suspects = stored(rows.groupBy("key", "n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    wanted = key_filter(suspects, "key")
    let_go(suspects)
    clash = stored(chunk_extremes(docs, wanted, chunk=chunk, moduli=moduli).filter("least <> greatest").select("key", "n_bytes").distinct())
    # each text of a fingerprint that stands for several is a group of its own
    if clash.limit(1).count():
        rows = rows.join(clash.withColumn("parted", F.lit(True)), ["key", "n_bytes"], "left").withColumn("part", F.when(F.col("parted"), F.col("sha")).otherwise("")).drop("parted")
    else:
        rows = rows.withColumn("part", F.lit(""))
    # repeated rows of one id meet in one row, with their number
    rows = stored(rows.groupBy("key", "n_bytes", "part", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n")))
    let_go(first, clash)
    groups = stored(rows.groupBy("key", "n_bytes", "part").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id")).filter("group_size > 1"))
    out = rows.join(groups, ["key", "n_bytes", "part"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL)
         AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
