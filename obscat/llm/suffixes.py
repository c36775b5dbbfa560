"""Two-stage suffix sorting of byte strings in numpy, and what repeats in them."""

from __future__ import annotations

import numpy as np


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; data is padded by at least eight."""
    return np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))


def direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions at, sorted by the depth bytes from each, by radix of eight bytes a round.

    Only positions that are still tied go into a round, and the sort is stable.
    """
    if not len(at):
        return at
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    done = 8
    open_ = np.arange(len(at))
    while done < depth:
        g = group[open_]
        tied = np.r_[False, g[1:] == g[:-1]]
        tied[:-1] |= tied[1:]
        open_ = open_[tied]
        if not len(open_):
            break
        here = at[open_]
        key = words[here + done].astype(np.uint64)
        if depth - done < 8:
            key &= ~np.uint64(0) << np.uint64(8 * (8 - (depth - done)))
        g = group[open_]
        order = np.lexsort((key, g))
        here, key, g = here[order], key[order], g[order]
        at[open_] = here
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        # a group's number is the place of its first member, so numbers stay in order
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        done += 8
    return at


def type_b(data: np.ndarray) -> np.ndarray:
    """Whether the suffix from each position is less than the one after it; the last is not."""
    nxt = np.r_[data[1:], np.uint8(0)]
    decided = np.flatnonzero(data != nxt)
    if not len(decided) or decided[-1] != len(data) - 1:
        decided = np.r_[decided, len(data) - 1]
    return np.repeat(data[decided] < nxt[decided], np.diff(np.r_[-1, decided]))


def two_stage(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of several ranges of data, sorted by the depth bytes from each.

    Position p is of type B if its byte is less than the next one, or equal and
    the next is of type B, else of type A.  Stage one sorts the B positions
    directly.  Stage two scans the buckets of first bytes in ascending order: the
    position before a sorted one, if it is of type A, takes the next free place at
    the front of its own bucket.  A bucket is scanned as a whole array; only runs
    of one byte take further steps within it.  Ranges may overlap; each must end
    after a B position or at the end of data.
    """
    n = len(data)
    is_b = type_b(data)
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, ends, -1)
    inside = np.cumsum(wanted[:-1]) > 0
    words = _words_at(np.r_[data, np.zeros(depth + 16, np.uint8)])
    b_at = direct_sort(words, np.flatnonzero(inside & is_b), depth)
    b_from = np.searchsorted(data[b_at], np.arange(257))  # B positions are in order of their first byte
    a_in = inside & ~is_b
    chunks: list[list[np.ndarray]] = [[] for _ in range(256)]
    # only the end of data can be an A position without a sorted successor
    last = np.flatnonzero(a_in & ~np.r_[inside[1:], False])
    for c in np.unique(data[last]):
        own = last[data[last] == c]
        chunks[c].append(own)
    out = []

    def scan(part: np.ndarray, c: int) -> np.ndarray:
        """Hand each sorted position's A predecessor to its bucket; give back those of this bucket."""
        before = part[part > 0] - 1
        before = before[a_in[before]]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
        mine = before[:0]
        for a, z in zip(cut, np.r_[cut[1:], len(first)]):
            if first[a] == c:
                mine = before[a:z]
            else:
                chunks[first[a]].append(before[a:z])
        return mine

    for c in range(256):
        wave = np.concatenate(chunks[c]) if chunks[c] else b_at[:0]
        chunks[c] = []
        while len(wave):  # A positions of this bucket, then those that a run of its byte adds
            out.append(wave)
            wave = scan(wave, c)
        part = b_at[b_from[c] : b_from[c + 1]]
        if len(part):
            out.append(part)
            scan(part, c)  # an A position never precedes a B position of its own byte
    return np.concatenate(out) if out else b_at


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, of the prefix that each sorted position shares with the one before it; 0 for the first."""
    words = _words_at(np.r_[data, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    done = 0
    while len(open_) and done < depth:
        differ = words[order[open_] + done].astype(np.uint64) ^ words[order[open_ - 1] + done].astype(np.uint64)
        same = differ == 0
        out[open_[same]] += 8
        rest = open_[~same]
        # equal leading bytes of the word where they part
        lead = differ[~same]
        for k in range(7):
            out[rest] += lead < (np.uint64(1) << np.uint64(56 - 8 * k))
        open_ = open_[same]
        done += 8
    return np.minimum(out, depth)
