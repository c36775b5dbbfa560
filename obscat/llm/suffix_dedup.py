"""Removal of byte strings that repeat across a corpus, by suffix sorting.

A window of WINDOW bytes is removed where the same window starts earlier.  Equal
windows have equal least GRAM-byte hashes, so the windows of a text fall into
runs with one least hash each, and all equal windows meet under that hash.

1. Blocks of texts send the distinct least hashes, and how often they occur, to
   hash ranges, which send back which of them occur more than once.  Windows
   under a hash that occurs once are unique.
2. Each block sends its other runs, the bytes that their windows cover, to the
   range of their hash; runs that equal an earlier one of the block are removed
   there and then, so that a passage of a third of all texts travels once a block.
3. A range sorts the suffixes of its distinct runs in two stages, takes common
   prefixes of neighbours, and in each stretch of neighbours that agree in WINDOW
   bytes keeps the earliest.  One bit for each window goes back to its block.

Everything is exact; hashes only bring together what is compared in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, frugal, frugal_group, let_go, mix64, pack, pieces, shards, stored, stored_by, texts, unpack
from .suffixes import common_prefixes, two_stage, type_b

#: Bytes that must repeat, and bytes of the hashes by which windows meet.
WINDOW, GRAM = 100, 36
BLOCK = 6 << 20
#: Ranges for suffix sorting, for each shard of the other exchanges: they hold text.
FINER = 8
_SLAB = 1 << 18


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each position."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    steps = [*range(0, gram - 7, 8)]
    if steps[-1] != gram - 8:
        steps.append(gram - 8)
    for k, at in enumerate(steps):
        total += np.ndarray((n,), "<u8", buffer=data[at:], strides=(1,)) * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        total ^= total >> np.uint64(29)
    return mix64(total)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def windows(rows: list[bytes], window: int, gram: int):
    """For each slab of rows: number of the first row, bytes, row of each byte, gram hashes, and each window's least hash (0: it leaves its row)."""
    first = 0
    while first < len(rows):
        last, size = first, 0
        while last < len(rows) and (last == first or size + len(rows[last]) < _SLAB):
            size += len(rows[last]) + 1
            last += 1
        data = np.frombuffer(b"\0".join(rows[first:last]) + b"\0", np.uint8)
        sizes = np.array([len(r) + 1 for r in rows[first:last]])
        row = np.repeat(np.arange(last - first, dtype=np.int32), sizes)
        if len(data) > window:
            h = gram_hashes(data, gram)
            least = sliding(h, window - gram + 1, np.minimum)
            # the window and the byte after it, at most the row's separator, are of one row
            n = len(data) - window
            yield first, data, row, h, np.where(row[:n] == row[window:], least[:n], np.uint64(0))
        first = last


def short_key(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def block_keys(rows: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct least hashes of a block, sorted, whether each is at several places, and their order by spread key.

    Least hashes are small numbers; ranges are cut of keys that are spread evenly.
    """
    width, found = window - gram + 1, []
    for _, _, _, h, least in windows(rows, window, gram):
        pad = np.zeros(width - 1, np.uint64)
        # a place is the least of some window if its hash is the greatest of the least hashes of the windows over it
        cover = sliding(np.r_[pad, least, pad], width, np.maximum)
        found.append(h[: len(cover)][h[: len(cover)] == cover[: len(h)]])
    keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return keys, n > 1, np.argsort(mix64(keys))


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return [*zip(first.tolist(), [*first[1:].tolist(), len(part)])]


_ROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("many", pa.binary()), ("text", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_ROW_SQL = "kind string, block long, part int, keys binary, many binary, text binary, docs array<bigint>, sizes array<bigint>"


def blocks(docs: DataFrame, parts: int, window: int, gram: int, block: int) -> DataFrame:
    """Rows of two kinds: blocks of texts, in order of doc_id, and their keys by range."""

    def run(batches):
        no = TaskContext.get().partitionId() << 32
        for b in (p for b in batches for p in pieces(b, 1, limit=block)):
            ids, rows = b.column(0).to_pylist(), texts(b.column(1))
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            ids, rows = [ids[i] for i in order], [rows[i] for i in order]
            keys, many, order = block_keys(rows, window, gram)
            keys, many = mix64(keys)[order], many[order]
            out = [("block", no, None, None, None, pack(b"".join(rows)), ids, [*map(len, rows)])]
            where = part_of(keys, parts)
            out += [("key", no, int(where[a]), pack(np.diff(short_key(keys[a:z]), prepend=np.uint64(0))), np.packbits(many[a:z]).tobytes(), None, None, None) for a, z in _cuts(where)]
            no += 1
            yield batch(_ROW, *map(list, zip(*out)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), _ROW_SQL)


_FLAG = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("flags", pa.binary())])


def repeated_keys(rows: DataFrame) -> DataFrame:
    """For each block and range, a bit for each key: whether it is at several places of the corpus."""

    def merge(found: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in found.column("keys").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(found.column("many").to_pylist(), keys)])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        flag = np.bincount(at, 1 + many)[at] > 1
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(flag[e - len(k) : e]).tobytes() for k, e in zip(keys, ends.tolist())]
        return pa.Table.from_batches([batch(_FLAG, found.column("block").to_pylist(), found.column("part").to_pylist(), bits)])

    return rows.select("block", "part", "keys", "many").groupBy("part").applyInArrow(frugal_group(merge), "block long, part int, flags binary")


def _rows_of(block_row) -> list[bytes]:
    whole, ends = unpack(block_row["text"], np.uint8).tobytes(), np.cumsum(block_row["sizes"]).tolist()
    return [whole[e - n : e] for n, e in zip(block_row["sizes"], ends)]


def runs_of(rows: list[bytes], flagged_keys: np.ndarray, window: int, gram: int):
    """Runs of windows under flagged keys: row, start, number of windows and key; and windows that repeat the one just before.

    In a stretch of one byte all windows but the first are of the latter kind.
    """
    out, repeats = [], []
    for first, data, row, _, least in windows(rows, window, gram):
        n = len(least)
        at = np.searchsorted(flagged_keys, least)
        at[at == len(flagged_keys)] = 0
        flagged = (least > 0) & (flagged_keys[at] == least) if len(flagged_keys) else np.zeros(n, bool)
        change = np.r_[0, np.cumsum(data[1:] != data[:-1])]
        plain = change[window - 1 : window - 1 + n] == change[:n]
        again = flagged & plain & np.r_[False, plain[:-1] & (row[1:n] == row[: n - 1])]
        keep = flagged & ~again
        same = np.r_[False, keep[:-1] & (least[1:] == least[:-1]) & (row[1:n] == row[: n - 1])]
        head = np.flatnonzero(keep & ~same)
        stop = np.flatnonzero(keep & ~np.r_[(keep & same)[1:], False])
        offset = np.searchsorted(row, np.arange(row[-1] + 1))
        out.append((np.stack([first + row[head], head - offset[row[head]], stop - head + 1]), least[head]))
        places = np.flatnonzero(again)
        repeats.append(np.stack([first + row[places], places - offset[row[places]]]))
    runs = np.concatenate([o[0] for o in out], axis=1) if out else np.zeros((3, 0), np.int64)
    keys = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.uint64)
    return runs, keys, np.concatenate(repeats, axis=1) if repeats else np.zeros((2, 0), np.int64)


_PART = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("runs", pa.binary()), ("parts", pa.binary()), ("dropped", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string())])
_PART_SQL = "kind string, block long, part int, text binary, docs array<bigint>, sizes array<bigint>, runs binary, parts binary, dropped binary, n_bytes long, sha string"


def sent_runs(rows: DataFrame, flags: DataFrame, parts: int, window: int, gram: int) -> DataFrame:
    """Rows of three kinds: texts without repeats (done), texts that may have some, and runs by range."""

    def run(found: pa.Table) -> pa.Table:
        own = next(r for r in found.select(["text", "docs", "sizes", "block"]).to_pylist() if r["text"] is not None)
        texts_, docs, no = _rows_of(own), own["docs"], own["block"]
        keys, _, order = block_keys(texts_, window, gram)
        flag = {p: f for p, f in zip(found.column("part").to_pylist(), found.column("flags").to_pylist()) if p is not None}
        where = part_of(mix64(keys)[order], parts // FINER)
        bits = [np.unpackbits(np.frombuffer(flag[int(where[a])], np.uint8), count=z - a) for a, z in _cuts(where)]
        if bits:
            repeated = np.zeros(len(keys), bool)
            repeated[order] = np.concatenate(bits).astype(bool)
            keys = keys[repeated]
        runs, run_keys, repeats = runs_of(texts_, keys, window, gram)
        touched = np.zeros(len(texts_), bool)
        touched[runs[0]] = True
        out = [("done", no, None, None, [docs[i]], None, None, None, None, len(texts_[i]), hashlib.sha256(texts_[i]).hexdigest()) for i in np.flatnonzero(~touched).tolist()]
        kept = np.flatnonzero(touched)
        renumber = np.cumsum(touched) - 1
        seen, first = set(), np.ones(runs.shape[1], bool)
        pieces_ = []
        for k, (i, s, n) in enumerate(runs.T.tolist()):
            piece = texts_[i][s : s + n + window - 1]
            if piece in seen:
                first[k] = False
            else:
                seen.add(piece)
            pieces_.append(piece)
        where = part_of(mix64(run_keys), parts).astype(np.int64)
        order = np.flatnonzero(first)
        order = order[np.argsort(where[order], kind="stable")]
        for a, z in _cuts(where[order]):
            mine = order[a:z]
            ids = [docs[i] for i in runs[0, mine].tolist()]
            out.append(("run", no, int(where[mine[0]]), pack(b"".join([pieces_[k] for k in mine.tolist()])), ids, None, pack(runs[:, mine].astype(np.int64)), None, None, None, None))
        if len(kept):
            sent = runs[:, order].copy()
            sent[0] = renumber[sent[0]]
            gone = runs[:, ~first].copy()
            gone[0] = renumber[gone[0]]
            again = np.stack([renumber[repeats[0]], repeats[1], np.ones(repeats.shape[1], np.int64)])
            out.append(("text", no, None, pack(b"".join([texts_[i] for i in kept.tolist()])), [docs[i] for i in kept.tolist()], [len(texts_[i]) for i in kept.tolist()], pack(sent.astype(np.int64)), pack(where[order]), pack(np.concatenate([gone, again], axis=1).astype(np.int64)), None, None))
        return pa.Table.from_batches([batch(_PART, *map(list, zip(*out)))])

    names = ["block", "part", "text", "docs", "sizes", "flags"]
    own = rows.withColumn("flags", F.lit(None).cast("binary")).select(names)
    flags = flags.select("block", "part", F.lit(None).cast("binary").alias("text"), F.lit(None).cast("array<bigint>").alias("docs"), F.lit(None).cast("array<bigint>").alias("sizes"), "flags")
    return own.unionByName(flags).groupBy("block").applyInArrow(frugal_group(run), _PART_SQL)


def repeated_starts(rows: list[bytes], window: int) -> list[np.ndarray]:
    """For runs of windows in order of occurrence, whether each window occurs at an earlier place."""
    if not rows:
        return []
    data = np.frombuffer(b"\0".join(rows) + b"\0", np.uint8)
    sizes = np.array([len(r) for r in rows])
    offset = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - window + 1
    b = np.flatnonzero(type_b(data))
    at = np.searchsorted(b, offset + n)
    stop = np.where(at < len(b), b[np.minimum(at, len(b) - 1)] + 1 if len(b) else 0, len(data))
    order = two_stage(data, offset, stop, window)
    counted = np.zeros(len(data) + 1, np.int32)
    np.add.at(counted, offset, 1)
    np.add.at(counted, offset + n, -1)
    is_start = np.cumsum(counted[:-1]) > 0
    order = order[is_start[order]]
    head = np.flatnonzero(common_prefixes(data, order, window) < window)
    removed = np.zeros(len(data), bool)
    removed[order] = True
    removed[np.minimum.reduceat(order, head)] = False
    return [removed[o : o + k] for o, k in zip(offset.tolist(), n.tolist())]


_BITS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])


def judged(runs: DataFrame, window: int) -> DataFrame:
    """For each block and range, a bit for each window of the runs that it sent."""

    def merge(found: pa.Table) -> pa.Table:
        ids, rows, nos, places, owner = [], [], [], [], []
        for k, (no, text, docs, packed) in enumerate(zip(*(found.column(c).to_pylist() for c in ("block", "text", "docs", "runs")))):
            whole, run = unpack(text, np.uint8).tobytes(), unpack(packed, np.int64).reshape(3, -1)
            ends = np.cumsum(run[2] + window - 1).tolist()
            rows += [whole[a:z] for a, z in zip([0, *ends], ends)]
            ids += docs
            nos += [no] * len(docs)
            owner += [k] * len(docs)
            places.append(run[:2])
        place = np.concatenate(places, axis=1)
        missing = np.array([i is None for i in ids])
        order = np.lexsort((place[1], place[0], np.array(nos), np.array([i or 0 for i in ids]), missing))
        seen, distinct = set(), []
        for i in order.tolist():
            if rows[i] not in seen:
                seen.add(rows[i])
                distinct.append(i)
        marks = dict(zip(distinct, repeated_starts([rows[i] for i in distinct], window)))
        bits: list[list] = [[] for _ in range(found.num_rows)]
        for i, k in enumerate(owner):
            bits[k].append(marks[i] if i in marks else np.ones(len(rows[i]) - window + 1, bool))
        return pa.Table.from_batches([batch(_BITS, found.column("block").to_pylist(), found.column("part").to_pylist(), [np.packbits(np.concatenate(b)).tobytes() for b in bits])])

    return runs.select("block", "part", "text", "docs", "runs").groupBy("part").applyInArrow(frugal_group(merge), "block long, part int, bits binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def cleaned(texts_rows: DataFrame, bits: DataFrame, window: int, *, with_text: bool) -> DataFrame:
    def run(found: pa.Table) -> pa.Table:
        own = next(r for r in found.select(["text", "docs", "sizes", "runs", "parts", "dropped"]).to_pylist() if r["text"] is not None)
        rows = _rows_of(own)
        runs, where, dropped = unpack(own["runs"], np.int64).reshape(3, -1), unpack(own["parts"], np.int64), unpack(own["dropped"], np.int64).reshape(3, -1)
        got = {p: b for p, b in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()) if p is not None}
        sizes = np.array(own["sizes"])
        offset = np.cumsum(sizes + 1) - sizes - 1
        edge = np.zeros(int(offset[-1] + sizes[-1]) + 2, np.int32)
        for a, z in _cuts(where):
            n = runs[2, a:z]
            mark = np.unpackbits(np.frombuffer(got[int(where[a])], np.uint8), count=int(n.sum())).astype(bool)
            start = np.repeat(offset[runs[0, a:z]] + runs[1, a:z] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.add.at(edge, start[mark], 1)
            np.add.at(edge, start[mark] + window, -1)
        start = offset[dropped[0]] + dropped[1]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + dropped[2] + window - 1, -1)
        gone = np.cumsum(edge) > 0
        out = []
        for i, row in enumerate(rows):
            mask = gone[offset[i] : offset[i] + sizes[i]]
            kept = np.frombuffer(row, np.uint8)[~mask].tobytes() if mask.any() else row
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))
            out.append((own["docs"][i], len(row), int(mask.sum()), spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([batch(_OUT, *map(list, zip(*out)))])

    names = ["block", "part", "text", "docs", "sizes", "runs", "parts", "dropped", "bits"]
    own = texts_rows.withColumn("bits", F.lit(None).cast("binary")).select(names)
    kinds = dict(own.dtypes)
    bits = bits.select("block", "part", *(F.lit(None).cast(kinds[c]).alias(c) for c in names[2:-1]), "bits")
    return own.unionByName(bits.select(names)).groupBy("block").applyInArrow(frugal_group(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """What repeats of window bytes leave of every row's text.

    Each byte goes that is covered by a window that also starts earlier: in a row
    of smaller doc_id, or earlier in the same one.  Windows are judged on the input
    and never cross rows.  Rows without id come last; rows of one id are ordered as
    they are read.  Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    with_text, kept (null where nothing was removed and the text itself stays).  A
    null text is empty; texts shorter than the window stay.  An empty table gives
    an empty result; other columns do not matter.
    """
    if not 8 <= gram <= window:
        raise ValueError("gram must be at least 8 and at most window")
    parts = shards(docs.sparkSession)
    texts_, keys = stored_by(blocks(docs, parts, window, gram, block), "kind", ("block", "key"))
    flags = stored(repeated_keys(keys))
    let_go(keys)
    touched, runs, done = stored_by(sent_runs(texts_, flags, parts * FINER, window, gram), "kind", ("text", "run", "done"))
    let_go(texts_, flags)
    bits = stored(judged(runs, window))
    let_go(runs)
    some = cleaned(touched, bits, window, with_text=with_text)
    zero = F.lit(0).cast("long")
    done = done.select(F.col("docs")[0].alias("doc_id"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.col("sha").alias("kept_sha256"))
    out = done.unionByName(some)
    return out if with_text else out.drop("kept")
