"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counts of all training n-grams are gathered exactly, then quantised on a
logarithmic scale; level j of an n-gram is a member of the filter for every j up
to its own level.  A count is read by probing levels from 1 until one is missing,
so errors only ever raise a count and large errors are exponentially rare.  Bigram
and unigram readings are smoothed into one probability.

Texts are tokenised once, in blocks.  A block sends its distinct words and pairs to
hash ranges (one packed row for each range, never one for each token), where they
are counted.  A range builds its own segment of the filter, as large as its counts
ask for, reads the block's n-grams from it and sends the readings back, for words
with the exact counts.  So no n-gram is left out at any size, nothing that grows
with the corpus is broadcast, and a word that fills a third of the corpus is one
entry for each block.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, batch, frugal, frugal_group, let_go, mix64, pack, shards, slabs, stored, stored_by, texts, unpack, words

#: Bytes of text that are tokenised as one block.
BLOCK = 4 << 20
#: Bits of a range's filter segment for each level of each n-gram that it holds: about a fifth of them is set.
ROOM = 16
#: Probes for each level, base of the logarithmic scale, and the deepest level.
PROBES, SCALE, DEEPEST = 4, 1.6, 48
#: What is taken off the count of each seen pair and given to the word's own frequency.
DISCOUNT = 0.95
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def remainder(doc_id) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix64(before * MULT + after)


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each count, 0 for none: level j stands for counts from SCALE**(j-1)."""
    with np.errstate(divide="ignore"):
        found = np.floor(np.log(np.maximum(counts, 1)) / np.log(SCALE) + 1e-9).astype(np.int64) + 1
    return np.where(counts > 0, np.minimum(found, DEEPEST), 0)


def level_counts() -> np.ndarray:
    """The count that each level stands for: the middle of its whole numbers."""
    low = np.ceil(SCALE ** np.arange(DEEPEST) - 1e-9)
    high = np.ceil(SCALE ** np.arange(1, DEEPEST + 1) - 1e-9) - 1
    return np.r_[0.0, np.sqrt(low * np.maximum(low, high))]


def room(counts: np.ndarray) -> int:
    """Bits of a segment for these counts, in which all of them have their place."""
    return max(64, -(-int(levels(counts).sum()) * ROOM // 64) * 64)


def segment(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """The filter's segment for the keys of one range, and the least count that it holds.

    With as many bits as room() gives, the least count is 1.  With fewer it rises
    until at most half of the bits are set.
    """
    depth, least = levels(counts), 1
    room = bits * np.log(2) / PROBES
    if depth.sum() > room:
        ladder = np.unique(counts)
        for least in ladder.tolist():
            if depth[counts >= least].sum() <= room:
                break
        else:
            least = int(ladder[-1]) + 1
    out = np.zeros(bits // 64, np.uint64)
    keys, depth = keys[counts >= least], depth[counts >= least]
    for level in range(1, int(depth.max(initial=0)) + 1):
        at = positions(keys[depth >= level], level, bits)
        at.sort()
        word = (at >> np.uint64(6)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
    return out, int(least)


def positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return np.concatenate([mix64(keys ^ np.uint64(mix_int(level * PROBES + k))) % np.uint64(bits) for k in range(PROBES)])


def mix_int(x: int) -> int:
    return int(mix64(np.array([x], np.uint64) * MULT)[0])


@dataclass(frozen=True)
class LogFrequencyFilter:
    """All segments, one after the other; a key's range is its segment."""

    data: np.ndarray
    parts: int
    bits: int  # of one segment

    def level(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Level of each key, read by probing upwards until a level is missing."""
        out = np.zeros(len(keys), np.int64)
        here = np.arange(len(keys))
        for level in range(1, DEEPEST + 1):
            at = positions(keys[here], level, self.bits) + np.tile(part[here] * np.uint64(self.bits), PROBES)
            hit = (self.data[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            here = here[hit.reshape(PROBES, -1).all(axis=0)]
            if not len(here):
                break
            out[here] = level
        return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Pairs are told apart by 40 bits, far more than the filter can resolve."""
    return hashes >> np.uint64(24)


_ROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_ROW_SQL = "kind string, block long, part int, keys binary, counts binary, tokens binary, docs array<bigint>, sizes array<bigint>"


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return [*zip(first.tolist(), [*first[1:].tolist(), len(part)])]


def tokenised(docs: DataFrame, parts: int, *, held: int = 1, block: int = BLOCK) -> DataFrame:
    """Rows of three kinds: blocks of token numbers, their words by range, their pairs by range; counts are of training tokens."""

    def one(no: int, ids: list, rows: list[bytes]):
        hashes, sizes = [], np.zeros(len(rows), np.int64)
        for first, last, data, ends in slabs(rows):
            starts, _, h = words(data)
            sizes[first:last] = np.diff(np.searchsorted(starts, ends), prepend=0)
            hashes.append(h)
        sizes += 1
        ends = np.cumsum(sizes)
        seq = np.empty(int(ends[-1]), np.uint64)
        is_end = np.zeros(len(seq), bool)
        is_end[ends - 1] = True
        seq[is_end], seq[~is_end] = _END, np.concatenate(hashes)
        learnt = np.array([(r := remainder(i)) is not None and r != held for i in ids])
        trained = np.repeat(learnt, sizes)
        vocab, number = np.unique(seq, return_inverse=True)
        counts = np.bincount(number[trained], minlength=len(vocab)).astype(np.uint32)
        out = [("block", no, None, pack(np.diff(vocab, prepend=np.uint64(0))), None, pack(number.astype(np.uint32)), ids, sizes.tolist())]
        where = part_of(vocab, parts)
        out += [("word", no, int(where[a]), pack(np.diff(vocab[a:z], prepend=np.uint64(0))), pack(counts[a:z]), None, None, None) for a, z in _cuts(where)]
        before = np.r_[_START, seq[:-1]]
        before[np.r_[0, ends[:-1]]] = _START
        pairs, at = np.unique(pair_hash(before, seq), return_inverse=True)
        n = np.bincount(at[trained], minlength=len(pairs))
        where, keys = part_of(pairs, parts), pair_keys(pairs)
        out += [("pair", no, int(where[a]), pack(np.diff(keys[a:z], prepend=np.uint64(0))), pack(n[a:z].astype(np.uint32)), None, None, None) for a, z in _cuts(where)]
        return batch(_ROW, *map(list, zip(*out)))

    def run(batches):
        no = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, rows = b.column(0).to_pylist(), [t.lower() for t in texts(b.column(1))]
            first, size = 0, 0
            for i, row in enumerate(rows):
                size += len(row) + 1
                if size >= block or i + 1 == len(rows):
                    yield one(no, ids[first : i + 1], rows[first : i + 1])
                    no, first, size = no + 1, i + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), _ROW_SQL)


_BACK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("levels", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
_BACK_SQL = "block long, part int, counts binary, levels binary, total long, distinct long"


def counted(rows: DataFrame, *, exact: bool) -> DataFrame:
    """For each range: totals (block null), and for each block the levels of its n-grams, with their exact counts if wanted."""

    def merge(found: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in found.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in found.column("counts").to_pylist()])
        sizes = [len(k) for k in keys]
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, counts, len(keys)).astype(np.int64)
        known = sums > 0
        bits = room(sums[known])
        data, _ = segment(keys[known], sums[known], bits)
        held, read = LogFrequencyFilter(data, 1, bits), np.zeros(len(keys), np.uint8)
        for k in range(0, len(keys), 1 << 20):
            part = keys[k : k + (1 << 20)]
            read[k : k + (1 << 20)] = held.level(part, np.zeros(len(part), np.uint64))
        part = found.column("part")[0].as_py()
        out = [(None, part, None, None, int(sums.sum()), int(known.sum()))]
        for b, n, e in zip(found.column("block").to_pylist(), sizes, np.cumsum(sizes).tolist()):
            mine = at[e - n : e]
            out.append((b, part, pack(sums[mine]) if exact else None, pack(read[mine]), None, None))
        return pa.Table.from_batches([batch(_BACK, *map(list, zip(*out)))])

    return rows.select("block", "part", "keys", "counts").groupBy("part").applyInArrow(frugal_group(merge), _BACK_SQL)


def totals(back: DataFrame) -> tuple[int, int]:
    """Tokens and distinct n-grams of all ranges."""
    found = back.filter("block IS NULL").agg(F.sum("total"), F.sum("distinct")).first()
    return found[0] or 0, found[1] or 0


@dataclass(frozen=True)
class Scorer:
    total: int
    distinct: int
    left: float  # share of all counts that is left when each pair's is discounted

    def score(self, vocab: np.ndarray, own: np.ndarray, paired: np.ndarray, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token of a block, under the smoothed pair model; own and paired are levels of its words and pairs."""
        stands = level_counts()
        own = stands[own]
        alone = (own + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        seq = vocab[number]
        before = np.r_[_START, seq[:-1]]
        before[starts] = _START
        seen = stands[paired][np.unique(pair_hash(before, seq), return_inverse=True)[1]]
        # a text's beginning is as frequent as its end
        end = own[np.searchsorted(vocab, _END)] if len(vocab) else 0.0
        context = np.r_[end, own[number[:-1]]]
        context[starts] = end
        share = np.where(context > 0, np.minimum(1.0, np.maximum(seen - DISCOUNT, 0) / np.maximum(context, 1)), 0.0)
        return np.log10(share + (self.left if self.total else 1.0) * alone[number])


def lm_scores(docs: DataFrame, *, held: int = 1, block: int = BLOCK) -> DataFrame:
    """Exact unigram and smoothed pair-model log10 probabilities of every row's text.

    The model learns from rows whose crc32(doc_id as text) mod 5 is not held; a row
    without id is scored but neither learnt from nor held out.  Tokens are
    ASCII-lowered words between spaces, then one end; a null text is empty and has
    the end alone.  Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  Repeated rows count as often as they occur.  An empty table
    gives an empty result; other columns do not matter.
    """
    spark = docs.sparkSession
    own, vocabularies, pairs = stored_by(tokenised(docs, shards(spark), held=held, block=block), "kind", ("block", "word", "pair"))
    back = stored(counted(vocabularies, exact=True))
    let_go(vocabularies)
    read = stored(counted(pairs, exact=False))
    let_go(pairs)
    total, distinct = totals(back)
    scorer = Scorer(total, distinct, DISCOUNT * totals(read)[1] / max(1, total))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(found: pa.Table) -> pa.Table:
        part, has_counts = found.column("part").to_pylist(), found.column("counts").is_valid().to_pylist()
        at = part.index(None)
        joined = lambda name, exact, dtype: np.concatenate([unpack(found.column(name)[k].as_py(), dtype) for _, k in sorted((p, k) for k, p in enumerate(part) if p is not None and has_counts[k] == exact)])
        vocab, number = np.cumsum(unpack(found.column("keys")[at].as_py(), np.uint64), dtype=np.uint64), unpack(found.column("tokens")[at].as_py(), np.uint32)
        c = joined("counts", True, np.int64)
        ids, sizes = found.column("docs")[at].as_py(), np.array(found.column("sizes")[at].as_py())
        starts = np.cumsum(sizes) - sizes
        base = np.log10((c + 0.5) / (scorer.total + 0.5 * (scorer.distinct + 1)))
        score = scorer.score(vocab, joined("levels", True, np.uint8), joined("levels", False, np.uint8), number, starts)
        sums = lambda x: np.add.reduceat(x, starts)
        known, low, high = sums((c > 0)[number].astype(np.int64)), sums(base[number]), sums(score)
        held_out = [remainder(i) == held for i in ids]
        return pa.Table.from_batches([batch(schema, ids, held_out, sizes, known, np.full(len(ids), scorer.total), low, high)])

    names = ["block", "part", "keys", "counts", "levels", "tokens", "docs", "sizes"]
    nothing = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    own = own.select("*", *nothing("binary", "levels")).select(names)
    for found in (back, read):
        found = found.filter("block IS NOT NULL").select("*", *nothing("binary", "keys", "tokens"), *nothing("array<bigint>", "docs", "sizes"))
        own = own.unionByName(found.select(names))
    return own.groupBy("block").applyInArrow(frugal_group(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
