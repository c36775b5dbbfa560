"""N-gram Jaccard self-join with PartEnum signatures, and the components of its links.

A document is the set of its word shingles.  Sets fall into bands by size; a band
[L, U] allows a largest symmetric difference k between two sets of at most U
members that are similar enough.  The feature domain is cut into n1 = k // 2 + 1
partitions of two cells each.  The k differing members cannot put two into each
partition, so some partition has at most one, and one of its two cells is the
same in both sets.  Enumerating the subsets of one cell, each non-empty cell's
content is a signature, and similar sets share one.  A set with so many empty
cells that the shared one may be empty signs its empty cells too.  A set that
can have partners in the next band signs there as well, as a visitor; a signature that
only visitors share brings no pair that their own band does not, and goes.  All of this
is exact: no similar pair is missed.

Equal sets are one class.  A class whose cells that nobody shares outnumber the
allowed difference has no partner and goes.  The others meet at one class of each
signature first (one pair for each member, not all pairs); links found there are
merged into components.  Two similar classes of different components share their
signatures with a third class that is like neither.  Of each class only its rarest
signatures are looked at then: small buckets give all their pairs, and in large ones
two classes differ from the centre in common members, which bring them together.
Pairs that share fewer cells than similar sets must are left out before any text is
fetched, and every candidate is then checked on the sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, MULT, batch, frugal, frugal_group, key_filter, let_go, mix64, pack, pack_columns, passing, pieces, shards, shrink, slabs, stored, stored_by, texts, unpack, unpack_columns, words
from .components import components, joined

WORDS = 4
#: Similarity as a fraction of whole numbers.
SIMILAR = (85, 100)
#: Bands double in size.  Narrower ones have fewer cells, of which a class then has to share hardly any.
BAND_RATIO = 2
#: Partitions for each one that the largest difference needs.  The more there are, the more cells similar sets must share.
SPARE = 1.5
#: Buckets of up to so many classes give all their pairs; larger ones give those that differ alike from their centre.
FEW = 16
_EMPTY = 1 << 14  # marks the signature of an empty cell, beside its band
_MANY, _HOME = 1, 2  # an entry that stands for several classes; one of the set's own band


class Bands:
    """Size bands, their cells, and the differences that similarity allows."""

    def __init__(self, similar=SIMILAR):
        self.num, self.den = similar
        self.lows = [1]
        while self.most(self.lows[0]) < 1:  # below, only equal sets are similar
            self.lows[0] += 1
        while self.lows[-1] < 1 << 31:
            self.lows.append(max(self.lows[-1] * BAND_RATIO, self.lows[-1] * self.den // self.num + 1))
        # two sets of at most U members: |difference| <= (1 - s) / (1 + s) * 2 U
        self.k = [(self.den - self.num) * 2 * (high - 1) // (self.den + self.num) for high in self.lows[1:]]
        self.partitions = [math.ceil(SPARE * (k // 2 + 1)) for k in self.k]

    def most(self, size: int) -> int:
        """Largest difference between a set of this size and a similar one."""
        return (self.den - self.num) * size // self.num

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of each size (-1: none), and the next band where a similar set can be in it (else -1)."""
        lows = np.array(self.lows)
        own = np.searchsorted(lows, sizes, side="right") - 1
        reach = sizes * self.den // self.num
        return own, np.where((own >= 0) & (reach >= lows[own + 1]), own + 1, -1)


def shingle_sets(rows: list[bytes], n: int = WORDS):
    """For each slab of texts: first row, sets of shingle hashes, concatenated and sorted, and their sizes.

    A text of fewer than n words has one shingle, the whole; one without words has none.
    """
    factors = [np.uint64((2 * k + 1) * int(MULT) % (1 << 64)) for k in range(n)]
    for first, last, data, ends in slabs(rows):
        starts, _, hashes = words(data)
        bound = np.searchsorted(starts, ends)
        out, sizes = [], np.zeros(last - first, np.int64)
        whole = len(hashes) - n + 1
        if whole > 0:
            mixed = np.zeros(whole, np.uint64)
            for k, f in enumerate(factors):
                mixed += mix64(hashes[k : k + whole] ^ f)
        low = 0
        for i, high in enumerate(bound.tolist()):
            if high - low >= n:
                s = np.unique(mix64(mixed[low : high - n + 1]))
            elif high > low:
                s = np.array([hash_sequence(hashes[low:high])], np.uint64)
            else:
                s = hashes[:0]
            out.append(s)
            sizes[i] = len(s)
            low = high
        yield first, np.concatenate(out), sizes


def hash_sequence(hashes: np.ndarray) -> np.uint64:
    value = np.array([len(hashes)], np.uint64)
    for h in hashes:
        value = mix64(value * MULT + h)
    return value[0]


def class_ids(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set; empty sets get 0."""
    ends = np.cumsum(sizes)
    total = np.zeros(len(members) + 1, np.uint64)
    np.cumsum(mix64(members + MULT), out=total[1:])
    ids = mix64((total[ends] - total[ends - sizes]) ^ (sizes.astype(np.uint64) * MULT))
    return np.where(sizes > 0, ids, np.uint64(0))


def signatures(members: np.ndarray, sizes: np.ndarray, band: np.ndarray, bands: Bands):
    """Set number, signature and band byte for each cell that the sets sign in the bands given (-1: none).

    Also, for each set, how many non-empty cells it signs; 0 for one that also signs its empty cells.
    """
    n1 = np.where(band >= 0, np.array(bands.partitions)[band], 0)
    cells = 2 * n1
    which = np.repeat(np.arange(len(sizes)), sizes)
    used = cells[which] > 0
    which, h = which[used], members[used]
    cell = ((h >> np.uint64(32)) * cells[which].astype(np.uint64)) >> np.uint64(32)
    place = which.astype(np.uint64) << np.uint64(32) | cell
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    content = np.add.reduceat(mix64(h), first) if len(first) else h
    who, cell = which[first], cell[first].astype(np.int64)
    signed = np.bincount(who, minlength=len(sizes))
    # partitions of which both cells hold something
    pair = who * (1 << 32) + cell // 2
    good = np.bincount(who[1:][pair[1:] == pair[:-1]], minlength=len(sizes))
    most = np.minimum((bands.den - bands.num) * sizes // bands.num, np.array(bands.k)[band])
    irregular = np.flatnonzero((n1 > 0) & (n1 - good >= n1 - most // 2))
    salt = mix64(band[who].astype(np.uint64) << np.uint64(40) | cell.astype(np.uint64))
    sig, tag = mix64(content ^ salt), band[who].astype(np.uint16)
    if len(irregular):
        extra_who = np.repeat(irregular, cells[irregular])
        extra_cell = np.concatenate([np.arange(c) for c in cells[irregular]])
        here = np.isin(extra_who * (1 << 32) + extra_cell, who * (1 << 32) + cell)
        extra_who, extra_cell = extra_who[~here], extra_cell[~here]
        salt = mix64(band[extra_who].astype(np.uint64) << np.uint64(40) | extra_cell.astype(np.uint64))
        who, sig = np.r_[who, extra_who], np.r_[sig, mix64(salt ^ MULT)]
        tag = np.r_[tag, (band[extra_who] | _EMPTY).astype(np.uint16)]
        signed[irregular] = 0
    return who, sig, tag, signed


_ENTRY = np.dtype([("sig", "<u8"), ("cls", "<u8"), ("tag", "<u2"), ("flags", "u1")])
_FIRST = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("band", pa.int32()), ("cells", pa.int32()), ("next_cells", pa.int32()), ("shard", pa.int32()), ("entries", pa.binary())])
_FIRST_SQL = "kind string, doc_id long, text_hash long, n long, cls long, band int, cells int, next_cells int, shard int, entries binary"
_LIVE = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("tag", pa.int32()), ("home", pa.bool_())])


def _packed(e: np.ndarray) -> bytes:
    """Entries in order of signature, as columns: differences of 48-bit signatures, and each class once.

    What shortened signatures bring together by chance is told apart by its sets.
    """
    ids, at = np.unique(e["cls"], return_inverse=True)
    columns = [np.diff(e["sig"] >> np.uint64(16), prepend=np.uint64(0)), ids, at.astype("<u2" if len(ids) < 1 << 16 else "<u4"), e["tag"], e["flags"]]
    out = [len(ids).to_bytes(8, "little")]
    for c in columns:
        data = pack(c)
        out += [len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def _unpacked(data: bytes) -> np.ndarray:
    classes = int.from_bytes(data[:8], "little")
    at, columns = 8, []
    for kind in ("<u8", "<u8", "<u2" if classes < 1 << 16 else "<u4", "<u2", "u1"):
        size = int.from_bytes(data[at : at + 8], "little")
        columns.append(unpack(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    e = np.empty(len(columns[0]), _ENTRY)
    e["sig"], e["cls"], e["tag"], e["flags"] = np.cumsum(columns[0], dtype=np.uint64), columns[1][columns[2]], columns[3], columns[4]
    return e


def _entries(sets_of_batch, bands: Bands) -> tuple[np.ndarray, np.ndarray, list]:
    """Forwarded entries (one for each signature of a batch), entries that they stand for, and the rows' columns."""
    columns, found = [], []
    for _, members, sizes in sets_of_batch:
        ids = class_ids(members, sizes)
        own, after = bands.of(sizes)
        signed = []
        for band, home in ((own, _HOME), (after, 0)):
            who, sig, tag, count = signatures(members, sizes, band, bands)
            e = np.empty(len(who), _ENTRY)
            e["sig"], e["cls"], e["tag"], e["flags"] = sig, ids[who], tag, home
            found.append(e)
            signed.append(count)
        columns.append((sizes, ids, own, *signed))
    entries = np.concatenate(found) if found else np.empty(0, _ENTRY)
    # of entries that share a signature one of the set's own band, if there is one, stands for all
    entries = entries[np.lexsort((entries["cls"], entries["flags"] ^ _HOME, entries["sig"]))]
    fresh = np.r_[True, (entries["sig"][1:] != entries["sig"][:-1]) | (entries["cls"][1:] != entries["cls"][:-1])] if len(entries) else np.zeros(0, bool)
    entries = entries[fresh]
    head = np.r_[True, entries["sig"][1:] != entries["sig"][:-1]] if len(entries) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    entries["flags"][at] |= np.where(np.diff(np.r_[at, len(entries)]) > 1, _MANY, 0).astype(np.uint8)
    return entries[head], entries[~head], [np.concatenate(c) for c in zip(*columns)] if columns else []


def first_pass(docs: DataFrame, *, n: int, bands: Bands, parts: int) -> DataFrame:
    """Rows of two kinds: one for each document (doc), and packed signatures for each shard (entry).

    Entries of shard -1 share their signature with another class of the same piece of a batch, which stands for them.
    """

    def run(batches):
        for b in (p for b in batches for p in pieces(b, 1, limit=4 << 20)):
            lead, rest, cols = _entries(shingle_sets([t.lower() for t in texts(b.column(1))], n), bands)
            if cols:
                size, ids, own, cells, later = cols
                none = pa.nulls(b.num_rows, pa.int32())
                yield batch(_FIRST, ["doc"] * b.num_rows, b.column(0), b.column(2), size, ids.view(np.int64), own.astype(np.int32), cells.astype(np.int32), later.astype(np.int32), none, pa.nulls(b.num_rows, pa.binary()))
            shard = (((lead["sig"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
            packed = [(int(shard[a]), _packed(lead[a:z])) for a, z in zip(cut, np.r_[cut[1:], len(shard)])]
            if len(rest):
                packed.append((-1, _packed(rest)))
            k = len(packed)
            yield batch(_FIRST, ["entry"] * k, *[pa.nulls(k, f.type) for f in list(_FIRST)[1:8]], [p[0] for p in packed], [p[1] for p in packed])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(frugal(run), _FIRST_SQL)


def _live_rows(e: np.ndarray) -> pa.RecordBatch:
    return batch(_LIVE, e["sig"].view(np.int64), e["cls"].view(np.int64), e["tag"].astype(np.int32), e["flags"] & _HOME != 0)


def shared_entries(entries: DataFrame) -> DataFrame:
    """sig, cls, tag, home of every signature that at least two classes share, one of them in its own band."""

    def merge(found: pa.Table) -> pa.Table:
        e = np.concatenate([_unpacked(x) for x in found.column("entries").to_pylist()])
        e = e[np.lexsort((e["cls"], e["sig"]))]
        group = np.cumsum(np.r_[True, e["sig"][1:] != e["sig"][:-1]]) - 1
        low = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        high = np.r_[low[1:], len(e)] - 1
        flags = np.bitwise_or.reduceat(e["flags"], low)
        live = ((e["cls"][low] != e["cls"][high]) | (flags & _MANY > 0)) & (flags & _HOME > 0)
        e = e[live[group]]
        return pa.Table.from_batches([_live_rows(e)])

    def rows_of(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield _live_rows(_unpacked(x))

    schema = "sig long, cls long, tag int, home boolean"
    forwarded = entries.filter("shard >= 0").select("shard", "entries").groupBy("shard").applyInArrow(frugal_group(merge), schema)
    return forwarded.unionByName(entries.filter("shard = -1").select("entries").mapInArrow(frugal(rows_of), schema)).distinct()


def class_texts(docs: DataFrame, involved: DataFrame, classes: DataFrame, *, n: int) -> DataFrame:
    """cls and a packed text of each of the involved classes, from one document of each.

    A text travels in a third of the bytes of its set.  A fixed-size filter of the
    ids picks the documents that are read again; rows without id are always read.
    A few classes that were not asked for may be there too.
    """
    involved = stored(involved.distinct())
    wanted, kept = key_filter(involved.join(classes, "cls").select("rep").dropna(), "rep"), key_filter(involved, "cls")
    let_go(involved)
    sent = docs.sparkSession.sparkContext.broadcast((wanted.bits, wanted.data, kept.bits, kept.data))
    schema = pa.schema([("cls", pa.int64()), ("text", pa.binary())])

    def run(batches):
        bits, data, bits2, data2 = sent.value
        wanted, kept = KeyFilter(bits, data), KeyFilter(bits2, data2)
        for b in (p for b in batches for p in pieces(b, 1)):
            ids = b.column(0)
            mask = np.array(ids.is_null().to_numpy(zero_copy_only=False)) | wanted.may_have(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows = [t.lower() for t in texts(b.column(1).filter(pa.array(mask)))]
            for first, members, sizes in shingle_sets(rows, n):
                cls = class_ids(members, sizes)
                take = np.flatnonzero(kept.may_have(cls) & (sizes > 0))
                yield batch(schema, cls[take].view(np.int64), [pack(b" ".join(rows[first + i].split())) for i in take.tolist()])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), "cls long, text binary")
    return rows.groupBy("cls").agg(F.first("text").alias("text"))


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted set of each packed text."""
    out = []
    for _, members, sizes in shingle_sets([unpack(x).tobytes() for x in column.to_pylist()], n):
        out += np.split(members, np.cumsum(sizes)[:-1])
    return out


def _with_texts(pairs: DataFrame, class_text: DataFrame) -> DataFrame:
    a, b = (class_text.select(F.col("cls").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similar, *, n: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""
    num, den = similar
    class_text = stored(class_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, n=n))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in (p for b in batches for p in pieces(b, 2, 3, limit=1 << 20)):
            ok = []
            for x, y in zip(_sets(t.column(2), n), _sets(t.column(3), n)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch(schema, t.column(0), t.column(1)).filter(pa.array(ok, pa.bool_()))

    full = _with_texts(pairs.select("a", "b"), class_text).select("a", "b", "text_a", "text_b")
    return full.mapInArrow(frugal(run), "a long, b long")


_DEALT = pa.schema([("part", pa.int32()), ("data", pa.binary())])
_SHARED = pa.schema([("c", pa.int64()), ("x", pa.int64()), ("label", pa.int64()), ("band", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("at", pa.int64()), ("member", pa.int64())])
_SHARED_SQL = "c long, x long, label long, band long, n long, d long, at long, member long"


def difference_pairs(met: DataFrame, class_text: DataFrame, similar, *, n: int) -> DataFrame:
    """Pairs (a, b, band) of classes of different labels that may be similar, out of met(a, b, label, band).

    Two classes x, y that met the same class c differ by |X| + |Y| - 2 |X & Y|,
    where X and Y are their symmetric differences from c.  If that is little
    enough without common members, both are similar to c and of one label.  Else
    X and Y have so many members in common that the first few of each, in one
    order, share one: members that c lacks come first, being the rarer ones.
    Members are dealt out packed, by a hash of centre and member; ranges give back
    those under which two labels meet.
    """
    num, den = similar
    gap = den - num
    parts = shards(met.sparkSession)

    def deal(batches):
        for t in (p for b in batches for p in pieces(b, 4, 5, limit=1 << 20)):
            rows, firsts = [], []
            for c, x, label, band, own, other in zip(*(t.column(k).to_pylist() for k in range(4)), _sets(t.column(4), n), _sets(t.column(5), n)):
                lacked, lost = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                d = len(lacked) + len(lost)
                k = gap * len(other) // num  # the most that it may differ from any similar class
                # least number in common with the difference of a similar class of another label
                if d * (den + num) > gap * (len(other) + len(own)):  # not similar to c
                    least = max(d - k, 1)
                else:  # then the other one is not
                    least = (d * (den + num) - gap * (len(other) - len(own))) // (2 * (den + num)) + 1
                firsts.append(np.r_[lacked, lost][: max(0, d - least + 1)])
                rows.append((c, x, label, band, len(other), d))
            if rows:
                row, sizes = np.array(rows, np.int64), np.array([*map(len, firsts)])
                owner, member = np.repeat(np.arange(len(rows)), sizes), np.concatenate(firsts)
                at = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                spread = mix64(member ^ mix64(row[owner, 0].view(np.uint64)))
                part = (((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(order) else order
                out = []
                for mine in np.split(order, cut[1:]) if len(order) else []:
                    used, local = np.unique(owner[mine], return_inverse=True)
                    out.append((int(part[mine[0]]), pack_columns(row[used].ravel(), local.astype(np.uint32), at[mine].astype(np.uint32), member[mine])))
                yield batch(_DEALT, [p for p, _ in out], [x for _, x in out])

    def meet(found: pa.Table) -> pa.Table:
        rows, at, member = [], [], []
        for data in found.column("data").to_pylist():
            row, local, place, value = unpack_columns(data, np.int64, np.uint32, np.uint32, np.uint64)
            rows.append(row.reshape(-1, 6)[local])
            at.append(place)
            member.append(value)
        rows, at, member = np.concatenate(rows), np.concatenate(at), np.concatenate(member)
        order = np.lexsort((rows[:, 3], member, rows[:, 0]))
        rows, at, member = rows[order], at[order], member[order]
        same = (rows[1:, 0] == rows[:-1, 0]) & (member[1:] == member[:-1]) & (rows[1:, 3] == rows[:-1, 3])
        head = np.flatnonzero(np.r_[True, ~same])
        mixed = np.minimum.reduceat(rows[:, 2], head) != np.maximum.reduceat(rows[:, 2], head)
        kept = np.repeat(mixed, np.diff(np.r_[head, len(rows)]))
        columns = [rows[kept, k] for k in range(6)]
        return pa.Table.from_batches([batch(_SHARED, *columns, at[kept].astype(np.int64), member[kept].view(np.int64))])

    dealt = _with_texts(met, class_text).select("a", "b", "label", "band", "text_a", "text_b").mapInArrow(frugal(deal), "part int, data binary")
    rows, key = stored(dealt.groupBy("part").applyInArrow(frugal_group(meet), _SHARED_SQL)), ["c", "band", "member"]
    left, right = rows, rows.select(*key, F.col("x").alias("y"), F.col("label").alias("y_label"), F.col("n").alias("y_n"), F.col("d").alias("y_d"), F.col("at").alias("y_at"))
    most = F.floor((F.col("n") + F.col("y_n")) * gap / (den + num))
    near = (F.col("label") < F.col("y_label")) & (F.abs(F.col("d") - F.col("y_d")) <= most) & (F.col("n") * den >= F.col("y_n") * num) & (F.col("y_n") * den >= F.col("n") * num)
    # no more members can be common than those from the first common one on
    near &= 2 * F.least(F.col("d") - F.col("at"), F.col("y_d") - F.col("y_at")) >= F.col("d") + F.col("y_d") - most
    return left.join(right, key).filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("band").cast("int").alias("band")).distinct()


def first_signatures(named: DataFrame, similar) -> DataFrame:
    """Of each class's signatures that several labels share, the rarest, so many that similar classes have one in common.

    A class shares all but k of its signed cells with a similar one.  In one order
    of signatures, rarest first, it can leave out the last of those but one.
    """
    num, den = similar
    size = named.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max("label").alias("top"), F.min("label").alias("low")).filter("top <> low").select("sig", "size")
    rows = named.join(stored(size), "sig")
    own = Window.partitionBy("cls", "band")
    needed = F.greatest(F.col("cells") - F.floor(F.col("n") * (den - num) / num), F.lit(1))
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("size", "sig"))).withColumn("live", F.count(F.lit(1)).over(own))
    return rows.filter(F.col("place") <= F.col("live") - needed + 1).select("sig", "cls", "band", "label", "a")


def shared_enough(pairs: DataFrame, held: DataFrame, similar) -> DataFrame:
    """The pairs (a, b, band) whose signatures of the band allow them to be similar.

    Each of d differing members can change one cell, so of the cells that a signs
    all but d are b's too, and the other way round.  held has a class's live
    signatures, size and number of signed cells in each band.
    """
    num, den = similar
    a, b = (held.select(F.col("cls").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"), F.col("sigs").alias(f"sigs_{x}")) for x in "ab")
    most = F.floor((F.col("n_a") + F.col("n_b")) * (den - num) / (den + num))
    alike = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    needed = F.greatest("cells_a", "cells_b") - most
    both = pairs.join(a, ["a", "band"]).join(b, ["b", "band"]).filter(alike)
    return both.filter(F.size(F.array_intersect("sigs_a", "sigs_b")) >= F.greatest(needed, F.lit(1))).select("a", "b")


def similar_classes(docs: DataFrame, entries: DataFrame, classes: DataFrame, *, n: int, similar, bands: Bands) -> DataFrame:
    """node, label: the components of similar classes; classes without partner are left out.  Lets the entries go."""
    num, den = similar
    live = stored(shared_entries(entries))
    let_go(entries)
    shrink(docs.sparkSession)
    k = F.floor(F.col("n") * (den - num) / num)
    each = F.explode(F.array(F.struct(F.col("band"), "cells"), F.struct((F.col("band") + 1).alias("band"), F.col("next_cells").alias("cells"))))
    signing = classes.select("cls", "rep", "n", k.alias("k"), each.alias("x")).select("cls", "rep", "n", "k", "x.*")
    counts = live.filter(F.col("tag") < _EMPTY).groupBy("cls", F.col("tag").alias("band")).agg(F.count(F.lit(1)).alias("live"))
    able = counts.join(signing, ["cls", "band"]).filter("cells - live <= k").select("cls", "band", "n", "k", "live", "cells")
    # classes that sign empty cells may share only those
    odd = live.filter(F.col("tag") >= _EMPTY).select("cls", (F.col("tag") - _EMPTY).alias("band")).distinct().join(signing, ["cls", "band"])
    odd = odd.select("cls", "band", "n", "k", F.lit(1 << 40).alias("live"), F.lit(0).alias("cells"))
    able = stored(able.unionByName(odd).groupBy("cls", "band", "n", "k").agg(F.max("live").alias("live"), F.min("cells").alias("cells")))
    dead = F.greatest(F.col("cells") - F.col("live"), F.lit(0)).alias("dead")
    signed = live.withColumn("band", F.col("tag") % _EMPTY).join(able.select("cls", "band", "n", "cells", dead), ["cls", "band"])
    signed = stored(signed.select("sig", "cls", "band", "home", "n", "cells", "dead"))
    let_go(live, able)
    # the class with the fewest cells of its own is the likeliest origin of the others
    centre = F.min_by(F.struct(F.col("cls").alias("a"), "home"), F.struct(~F.col("home"), "dead", "cls"))
    buckets = signed.groupBy("sig").agg(centre.alias("centre"), F.min("cls").alias("low"), F.max("cls").alias("top"))
    buckets = stored(buckets.filter("low <> top AND centre.home").select("sig", "centre.a"))
    members = stored(signed.join(buckets, "sig").select("sig", "cls", "band", "home", "n", "cells", "a"))
    let_go(signed, buckets)
    shrink(docs.sparkSession)
    held = stored(members.groupBy("cls", "band", "n", "cells").agg(F.collect_list("sig").alias("sigs")))

    # one pair for each member of a bucket
    stars = stored(members.filter(F.col("cls") != F.col("a")).select("a", F.col("cls").alias("b"), "band").distinct())
    likely = stored(shared_enough(stars, held, similar).distinct())
    let_go(stars)
    links = stored(verified(docs, classes, likely, similar, n=n))
    labels = stored(components(links))
    let_go(likely, links)
    shrink(docs.sparkSession)

    # pairs across components: of small buckets all, of large ones those that differ alike from the centre
    names = labels.select(F.col("node").alias("cls"), "label")
    named = members.join(names, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    firsts = stored(first_signatures(named, similar))
    let_go(members)
    size = firsts.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max("label").alias("top"), F.min("label").alias("low")).filter("top <> low").select("sig", "size")
    size = stored(size)
    few = firsts.join(size.filter(F.col("size") <= FEW).select("sig"), "sig").groupBy("sig", "band").agg(F.collect_list(F.struct("cls", "label")).alias("x"))
    pair = lambda x, y: F.struct(F.least(x["cls"], y["cls"]).alias("a"), F.greatest(x["cls"], y["cls"]).alias("b"))
    every = F.flatten(F.transform("x", lambda x: F.transform(F.filter("x", lambda y: y["label"] > x["label"]), lambda y: pair(x, y))))
    across = stored(few.select("band", F.explode(every).alias("p")).select("p.a", "p.b", "band").distinct())
    met = firsts.join(size.filter(F.col("size") > FEW).select("sig"), "sig").filter("cls <> a")
    met = stored(met.select("a", F.col("cls").alias("b"), "label", "band").distinct())
    let_go(firsts, size)
    likely = [stored(shared_enough(across, held, similar).distinct())]
    let_go(across)
    if met.limit(1).count():
        class_text = stored(class_texts(docs, met.select(F.explode(F.array("a", "b")).alias("cls")), classes, n=n))
        across = stored(difference_pairs(met, class_text, similar, n=n))
        likely.append(stored(shared_enough(across, held, similar).distinct()))
        let_go(class_text, across)
    let_go(met, held)
    shrink(docs.sparkSession)
    more = stored(verified(docs, classes, reduce(DataFrame.unionByName, likely).distinct(), similar, n=n))
    let_go(*likely)
    return stored(joined(labels, more)) if more.limit(1).count() else labels


def similar_documents(docs: DataFrame, *, n: int = WORDS, similar=SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, label and text_hash for every row of docs.

    Two rows link when the Jaccard similarity of their shingle sets is at least
    similar; component_id is the smallest doc_id that links reach, itself
    included, label a number of the component and text_hash xxhash64 of the text.
    Words are split at spaces and ASCII-lowered.  A text without words, or null,
    has no shingle and links with nothing, so its component_id is its own id and
    its label null.  Rows without id take part in links; the least id of a
    component that has none is null.  Repeated rows are in one component.  An empty
    table gives an empty result; other columns of docs do not matter.
    """
    bands = Bands(similar)
    with passing(docs.sparkSession) as keep:
        first, entries = stored_by(first_pass(docs, n=n, bands=bands, parts=2 * shards(docs.sparkSession)), "kind", ("doc", "entry"))
        shrink(docs.sparkSession)
        rows = keep(first).select("doc_id", "text_hash", "n", "cls", "band", "cells", "next_cells")
        classes = stored(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), *(F.max(c).alias(c) for c in ("n", "band", "cells", "next_cells"))))
        labels = similar_classes(docs, entries, classes, n=n, similar=similar, bands=bands)
        named = labels.join(classes, labels["node"] == classes["cls"]).select("cls", "label", "rep")
        least = named.groupBy("label").agg(F.min("rep").alias("least"))
        comps = named.join(least, "label").select("cls", "label", "least")
        known = classes.select("cls", "rep").join(comps, "cls", "left")
        known = keep(stored(known.select("cls", F.coalesce("label", "cls").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))))
    out = rows.join(known, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label", "text_hash")
