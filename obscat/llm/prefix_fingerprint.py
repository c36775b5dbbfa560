"""Document fingerprints from prefix polynomial hashes.

The prefixes of a text are hashed at one base modulo two 31-bit primes.  The
difference of two entries of the array is the hash of a span, so any two spans
compare in constant time, and the longest common extension of two places is found
by binary search.

The fingerprint that is returned samples that array: the hash of the whole text,
and the prefix hashes at places that the text itself chooses, those after which
the least hashes of WINDOW letters stand.  Equal stretches of two texts choose equal
places, so fingerprints compare without the texts: spans between sampled places
have known hashes.  With the arrays at hand, common spans are grown from the front,
the back and each pair of places after equal windows, as far as both sides agree,
and two texts are alike by the share of the longer one that such spans cover.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, frugal, mix64, shards

PRIMES = (2147483647, 2147483629)
BASE = 911382323
#: Letters before a sampled place that choose it, places that the fingerprint names, and places from which common spans are grown.
WINDOW, PLACES, ANCHORS = 12, 24, 64


#: Numbers that are worked on at once; arrays over a whole text have four bytes for each letter and prime.
BLOCK = 1 << 20


class Powers:
    """BASE**i modulo each prime, grown as needed."""

    def __init__(self, primes=PRIMES, base: int = BASE):
        self.primes, self.base, self.size = primes, base, 1
        self.tables = [np.ones(1, np.uint32) for _ in primes]

    def upto(self, n: int) -> list[np.ndarray]:
        if self.size < n:
            room = max(n, 2 * self.size)
            for k, p in enumerate(self.primes):
                t, done = np.empty(room, np.uint32), self.size
                t[:done] = self.tables[k][:done]
                while done < room:
                    m = min(done, BLOCK, room - done)
                    t[done : done + m] = t[:m].astype(np.uint64) * np.uint64(pow(self.base, done, p)) % np.uint64(p)
                    done += m
                self.tables[k] = t
            self.size = room
        return self.tables


class PrefixHash:
    """Prefix hashes of a sequence of code points."""

    __slots__ = ("n", "powers", "prefix", "places")

    def __init__(self, points: np.ndarray, powers: Powers):
        self.n, self.powers = len(points), powers
        self.places = sampled(points, powers)
        self.prefix = []
        for table, p in zip(powers.upto(self.n + 1), powers.primes):
            out, last = np.zeros(self.n + 1, np.uint32), 0
            for at in range(0, self.n, BLOCK):
                values = (points[at : at + BLOCK].astype(np.uint64) + np.uint64(1)) * table[at : at + len(points[at : at + BLOCK])] % np.uint64(p)
                sums = (np.cumsum(values) + np.uint64(last)) % np.uint64(p)
                out[at + 1 : at + 1 + len(sums)] = sums
                last = int(sums[-1])
            self.prefix.append(out)

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether self[i:i+length] and other[j:j+length] have equal hashes."""
        for a, b, power, p in zip(self.prefix, other.prefix, self.powers.upto(max(i, j) + 1), self.powers.primes):
            x, y = int(a[i + length]) - int(a[i]), int(b[j + length]) - int(b[j])
            if (x * int(power[j]) - y * int(power[i])) % p:
                return False
        return True

    def forward(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the right of i and j."""
        return self._most(min(self.n - i, other.n - j), lambda k: self.equal(i, other, j, k))

    def backward(self, i: int, other: PrefixHash, j: int, most: int) -> int:
        """Length of the longest common extension to the left of i and j, at most most."""
        return self._most(min(i, j, most), lambda k: self.equal(i - k, other, j - k, k))

    @staticmethod
    def _most(high: int, holds) -> int:
        low = 0
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if holds(mid) else (low, mid - 1)
        return low

    def common_spans(self, other: PrefixHash) -> list[tuple[int, int, int]]:
        """(start here, start there, length) of spans in common, in order and apart in both texts.

        They are grown to both sides from the front, the back and places after
        equal windows, and taken longest first.
        """
        found = []
        front = self.forward(0, other, 0)
        if front:
            found.append((0, 0, front))
        back = self.backward(self.n, other, other.n, min(self.n, other.n) - front)
        if back:
            found.append((self.n - back, other.n - back, back))
        for window, here in self.places.items():
            there = other.places.get(window)
            if there is None or any(i <= here <= i + n and here - i == there - j for i, j, n in found):
                continue
            left, right = self.backward(here, other, there, self.n), self.forward(here, other, there)
            if left + right:
                found.append((here - left, there - left, left + right))
        taken: list[tuple[int, int, int]] = []
        for i, j, n in sorted(found, key=lambda s: (-s[2], s[0])):
            for x, y, m in taken:  # what is left of the span beside those taken; crossing ones go
                if x + m <= i and y + m <= j or i + n <= x and j + n <= y:
                    continue
                if x <= i and y <= j:
                    cut = max(x + m - i, y + m - j)
                    i, j, n = i + cut, j + cut, n - cut
                elif i <= x and j <= y:
                    n = min(x - i, y - j)
                else:
                    n = 0
                if n <= 0:
                    break
            if n > 0:
                taken.append((i, j, n))
        return sorted(taken)

    def likeness(self, other: PrefixHash) -> float:
        """Share of the longer text that common spans cover; 1 for two empty ones."""
        longer = max(self.n, other.n)
        return sum(n for _, _, n in self.common_spans(other)) / longer if longer else 1.0

    def digest(self) -> str:
        """Length and hash of the text, then place and prefix hash of each sampled place."""
        entry = lambda at: "".join(f"{int(x[at]):08x}" for x in self.prefix)
        return ".".join([f"{self.n:x}-{entry(self.n)}", *(f"{at:x}-{entry(at)}" for at in sorted([*self.places.values()][:PLACES]))])


def sampled(points: np.ndarray, powers: Powers) -> dict[int, int]:
    """The places after the ANCHORS least windows, by the window's hash, least first; of equal windows the first counts."""
    found: dict[int, int] = {}
    weights = [np.uint64(x) for x in powers.upto(WINDOW)[0][:WINDOW].tolist()]
    for at in range(0, len(points) - WINDOW + 1, BLOCK):
        values = points[at : at + BLOCK + WINDOW - 1].astype(np.uint64) + np.uint64(1)
        n = len(values) - WINDOW + 1
        total = np.zeros(n, np.uint64)
        for k, w in enumerate(weights):
            total += values[k : k + n] * w
        marks = mix64(total % np.uint64(powers.primes[0]))
        few = marks[np.argpartition(marks, ANCHORS - 1)[:ANCHORS]] if n > ANCHORS else marks
        where = np.flatnonzero(marks <= few.max())
        for mark, place in zip(marks[where].tolist(), where.tolist()):
            found.setdefault(mark, at + place + WINDOW)
        if len(found) > 4 * ANCHORS:
            found = {m: found[m] for m in sorted(found)[:ANCHORS]}
    return {m: found[m] for m in sorted(found)[:ANCHORS]}


def likeness_of_fingerprints(a: str, b: str) -> float:
    """How alike two fingerprints say their texts are, without the texts: the share of the longer one in spans between sampled places that have equal hashes."""

    def spans(text: str) -> tuple[int, str, Counter]:
        whole, *rest = (x.split("-") for x in text.split("."))
        places = [(0, "0" * 16), *((int(at, 16), h) for at, h in rest), (int(whole[0], 16), whole[1])]
        out: Counter = Counter()
        for (i, x), (j, y) in zip(places, places[1:]):
            if j > i:
                parts = []
                for k, p in enumerate(PRIMES):
                    low, high = int(x[8 * k : 8 * k + 8], 16), int(y[8 * k : 8 * k + 8], 16)
                    parts.append((high - low) * pow(pow(BASE, i, p), -1, p) % p)
                out[j - i, *parts] += 1
        return places[-1][0], whole[1], out

    (n, whole_a, x), (m, whole_b, y) = spans(a), spans(b)
    if n == m and whole_a == whole_b:
        return 1.0
    return sum(k[0] * c for k, c in (x & y).items()) / max(n, m)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _followed(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, halo, doc_id, text: documents in ranges of doc_id, each range ending with the next one's first.

    Ranges are bounded by parts - 1 quantiles of the ids; only those and the first
    id of each range come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    bounds = np.unique(np.array(cuts if parts > 1 and cuts else [], np.int64))
    schema = pa.schema([("bucket", pa.int32()), ("halo", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def bucket_of(ids: pa.Array) -> np.ndarray:
        """Range of each id; a null id comes before all others."""
        known = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, known)

    def least(batches):
        for b in batches:
            yield batch(pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64())]), bucket_of(b.column(0)).astype(np.int32), b.column(0))

    found = rows.select("doc_id").mapInArrow(frugal(least), "bucket int, doc_id long").groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first")).orderBy("bucket").collect()
    order = [r["bucket"] for r in found]
    firsts = [r["first"]["doc_id"] for r in found]
    # the range before each, going round: it ends with the first row of this one
    before = {first: order[k - 1] for k, first in enumerate(firsts)}

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            zero = np.zeros(b.num_rows, np.int32)
            yield batch(schema, bucket_of(ids).astype(np.int32), zero, ids, b.column(1))
            at = [(i, before[x]) for i, x in enumerate(ids.to_pylist()) if x in before]
            if at:
                rows = pa.array([i for i, _ in at])
                yield batch(schema, [k for _, k in at], np.ones(len(at), np.int32), ids.take(rows), b.column(1).take(rows))

    dealt = rows.mapInArrow(frugal(deal), "bucket int, halo int, doc_id long, text string")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("bucket")).sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last n_chars // 4 code points replaced by the first as
    many, or all, of the next document by ascending doc_id; after the last comes
    the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next for each row.  A null text is empty.
    Rows without id come before all others; rows of one id follow each other by
    their text.  A single row is its own next one.  An empty table gives an empty
    result; other columns do not matter.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        powers, held, ended = Powers(), None, False
        out = []
        for b in batches:
            for halo, doc_id, text in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                if ended:
                    break
                here = PrefixHash(points(text), powers)
                if held is not None:
                    out.append(_row(*held, text, here, powers))
                held, ended = (doc_id, text, here), bool(halo)  # rows after the first of the next range are not needed
            if out:
                yield batch(schema, *map(list, zip(*out)))
                out = []

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _followed(docs, shards(docs.sparkSession)).mapInArrow(frugal(run), columns)


def _row(doc_id, text: str, own: PrefixHash, after: str, following: PrefixHash, powers: Powers) -> tuple:
    k = len(text) // 4
    changed = text[: len(text) - k] + after[:k]
    edited = own if changed == text else PrefixHash(points(changed), powers)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.digest(), edited.digest(), own.likeness(edited), own.likeness(following)
