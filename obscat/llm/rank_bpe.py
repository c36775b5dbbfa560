"""BPE encoding and decoding with a contiguous rank array for each word.

A word of a few dozen parts is held as its part boundaries and, beside them, the
ranks of adjacent pairs.  The smallest rank is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed; for short words this beats any
heap.  The words that a batch of texts brings anew are columns of one matrix and
take these steps together.  Long words take the same merges from a heap over
linked parts, so that no word is quadratic.  Normalisation, splitting and the handling of special tokens follow
the vocabulary file's own declarations for this kind of tokenizer.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, frugal, held

#: Bytes up to which a word is scanned; longer ones use a heap.
SHORT = 63
#: Words in each of the two generations a worker remembers; the memory of them is bounded.
CACHE_WORDS, CACHE_LENGTH = 80_000, 64
_NONE = 1 << 30

# Fixed values of this tokenizer format: white space as the Unicode property has it.
SPACE_RUN = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter for each byte value, as byte-level vocabularies write it."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-level BPE vocabulary with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("pairs of ids are packed into 32 bits, so a vocabulary must have fewer than 65,536 entries")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = np.array([self.name.get(i) for i in range(max(self.name) + 1)], object)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int32)
        self.made = np.array([new for _, new in sorted(self.pairs.values())], np.int32)
        self._table()
        self.young: dict[str, tuple[int, bytes]] = {}
        self.old: dict[str, tuple[int, bytes]] = {}

    def _table(self) -> None:
        """Ranks of pairs in an open-addressing table for whole arrays of pairs."""
        bits = max(10, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.keys, self.ranks = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, _NONE, np.int32)
        for (a, b), (rank, _) in self.pairs.items():
            key = a << 16 | b
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> int(self.shift)
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) % (1 << bits)
            self.keys[at], self.ranks[at] = key, rank

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = ((key * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NONE)
        todo = np.flatnonzero((found != key) & (found != 0xFFFFFFFF))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != 0xFFFFFFFF)]
        return out

    def merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; no word is empty or over SHORT bytes.

        Column w of each matrix belongs to word w.  ranks[i, w] holds the rank of
        the pair that starts at boundary i, with i in its low bits, so that a
        minimum over the column is the leftmost of the best pairs.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        top = int(size.max())
        chars = np.zeros((n, top), np.uint8)
        chars[np.arange(top) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[chars.T]
        column = np.arange(n)
        ids[size - 1, column] = self.last[chars[column, size - 1]]
        alive = np.arange(top)[:, None] < size
        after = np.repeat(np.arange(1, top + 2, dtype=np.int16)[:, None], n, 1)
        after[size - 1, column] = top
        before = np.repeat(np.arange(-1, top, dtype=np.int16)[:, None], n, 1)
        ranks = np.full((top, n), _NONE, np.int32)
        for i in range(top - 1):
            some = np.flatnonzero(size > i + 1)
            r = self.rank(ids[i, some], ids[i + 1, some])
            ranks[i, some] = np.where(r < _NONE, r << 6 | i, _NONE)
        flat = {"ids": ids, "alive": alive}
        live, view = column, ranks
        while True:
            best = view.min(axis=0)
            going = np.flatnonzero(best < _NONE)
            if not len(going):
                break
            if len(going) * 2 < len(live):  # finished words leave the scan
                live, view, best = live[going], np.ascontiguousarray(view[:, going]), best[going]
                going = np.arange(len(live))
            w, best = live[going], best[going]
            i = best & 63
            new = self.made[best >> 6]
            j = after[i, w]
            k = after[j, w].astype(np.int64)
            flat["ids"][i, w] = new
            flat["alive"][j, w] = False
            after[i, w] = k
            before[k, w] = i
            view[j, going] = _NONE
            r = np.full(len(w), _NONE, np.int32)
            has = np.flatnonzero(k < top)
            r[has] = self.rank(new[has], ids[k[has], w[has]])
            view[i, going] = np.where(r < _NONE, r << 6 | i, _NONE)
            h = before[i, w].astype(np.int64)
            has = np.flatnonzero(h >= 0)
            r = self.rank(ids[h[has], w[has]], new[has])
            view[h[has], going[has]] = np.where(r < _NONE, r << 6 | h[has].astype(np.int32), _NONE)
        return ids.T[alive.T], alive.sum(axis=0)

    def merge_heap(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, for long words."""
        get, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := get((new, ids[k])):
                    heapq.heappush(heap, (p[0], i, new, ids[k], p[1]))
            if (h := before[i]) >= 0 and (p := get((ids[h], new))):
                heapq.heappush(heap, (p[0], h, ids[h], new, p[1]))
        return [x for x in ids if x >= 0]

    def coded(self, words: set[str]) -> dict[str, tuple[int, bytes]]:
        """For each word: number of tokens, ids as little-endian 32-bit integers."""
        young, old = self.young, self.old
        out, new = {}, []
        for w in words:
            known = young.get(w)
            if known is None:
                known = old.get(w)
                if known is None:
                    new.append(w)
                    continue
                young[w] = known
            out[w] = known
        new.sort(key=len)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            raw = [w.encode() for w in part]
            short = [k for k, x in enumerate(raw) if len(x) <= SHORT]
            if short:
                ids, count = self.merge_together([raw[k] for k in short])
                data, here = ids.astype("<u4").tobytes(), 0
                for k, c in zip(short, count.tolist()):
                    out[part[k]] = c, data[4 * here : 4 * (here + c)]
                    here += c
            for k, x in enumerate(raw):
                if len(x) > SHORT:
                    ids = self.merge_heap([*self.inner[[*x[:-1]]].tolist(), int(self.last[x[-1]])])
                    out[part[k]] = len(ids), b"".join(i.to_bytes(4, "little") for i in ids)
        for w in new:
            if len(w) <= CACHE_LENGTH:
                young[w] = out[w]
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return out

    def normalised(self, text: str) -> str:
        text = SPACE_RUN.sub(" ", unicodedata.normalize("NFC", text))
        # letter by letter: a final capital sigma takes its plain lower-case form
        return text.replace("Σ", "σ").lower()

    def split_text(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand for themselves."""
        pieces = self.parts.split(text) if self.parts else [text]
        if len(pieces) == 1:
            return self.split.findall(self.normalised(text))
        out = []
        for k, piece in enumerate(pieces):
            out += [piece] if k % 2 else self.split.findall(self.normalised(piece))
        return out

    def runs(self, texts: list[str]) -> list[list[tuple[int, bytes]]]:
        """The coded words and special tokens of each text, in order."""
        split = [self.split_text(t) for t in texts]
        words = set().union(*split)
        special = words & self.special.keys()  # no word of the split pattern mixes letters and signs as these do
        known = self.coded(words - special) | {t: (1, self.special[t].to_bytes(4, "little")) for t in special}
        return [[*map(known.__getitem__, s)] for s in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(r[1] for r in self.runs([text])[0]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary names no decoder of its own."""
        return " ".join(self.name[i] for i in ids if i in self.name)

    def decode_packed(self, ids: bytes) -> str:
        """The same of packed ids, which must all be of the vocabulary."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())

    def rows(self, texts: list[str]) -> tuple[list[int], list[bytes], list[str]]:
        """For each text: number of tokens, packed ids, and the text that these ids decode to."""
        coded = self.runs(texts)
        ids = [b"".join(r[1] for r in c) for c in coded]
        return [sum(r[0] for r in c) for c in coded], ids, [*map(self.decode_packed, ids)]


_KIND = "rank_bpe"


def loaded(path: str) -> WordBpe:
    """One coder per worker and vocabulary, kept until the worker has a task of another kind."""
    coders = held(_KIND)
    if path not in coders:
        coders[path] = WordBpe(path)
    return coders[path]


def bpe_codes(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit), decoded text for each row.

    A null text is empty: no ids and an empty decoded text.  Rows keep their
    number and need no exchange; repeated rows and other columns do not matter.
    The vocabulary at path must be readable on every worker.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        coder = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # results of a few rows at a time
                part = b.slice(at, 512)
                yield batch(schema, part.column(0), *coder.rows([t or "" for t in part.column(1).to_pylist()]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run, _KIND), "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, from ids that are decoded again."""
    return bpe_codes(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
