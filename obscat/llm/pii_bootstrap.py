"""Personal data by fixed patterns, and more of it by bootstrapped contexts.

Seed entities (what the fixed patterns find, and key-like hexadecimal strings)
occur in lexical contexts: the two words before, or the words on either side.
Contexts and fillers form a graph, which is scored in rounds on Spark: a context
is as good for a kind as the mean score of its distinct fillers, an unknown
filler as good as the contexts it occurs in, and good for contexts without a seed
too: each round reaches one context further.  Contexts that are confident, have
enough distinct fillers and are pure in kind discover the identifiers that no
fixed pattern knows.  The texts are read once: candidates are written with their
contexts, and only those narrow rows are joined.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, frugal, passing, stored, stored_by

KINDS = ("email", "ip", "card", "phone", "secret")
#: Rounds over the graph, and what a context must have to discover: mean score, distinct fillers.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 4
#: Fillers are held back by so many unknown ones that each context has beside its own.
DAMPING = 0.5
#: A candidate has at least so many characters and digits.
LEAST_LENGTH, LEAST_DIGITS = 6, 4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from each, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_SECRET = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}|(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,}")
_EDGE = "\"'`.,;:!?()[]{}<>|*"


def _emails(text: str):
    """Leftmost non-overlapping addresses, from one @ to the next: no start is tried twice."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _short(word: str) -> str:
    word = word.lower()
    return word if len(word) <= 32 else hashlib.md5(word.encode()).hexdigest()


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None, str, list[str]]]:
    """start, end, seed kind (None: unknown), filler and contexts of seeds and candidates."""
    if not base and not _DIGIT.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    taken = sorted((a, z) for _, a, z in base)
    found = [(a, z, kind) for kind, a, z in base]
    for a, z in tokens:
        word = text[a:z]
        if len(word) < LEAST_LENGTH or sum("0" <= c <= "9" for c in word) < LEAST_DIGITS:
            continue
        a += len(word) - len(word.lstrip(_EDGE))
        z -= len(word) - len(word.rstrip(_EDGE))
        k = bisect.bisect_left(taken, (z,))
        if z - a < LEAST_LENGTH or any(x < z and a < y for x, y in taken[max(0, k - 4) : k]):
            continue
        found.append((a, z, 4 if _SECRET.fullmatch(text, a, z) else None))
    out = []
    for a, z, kind in found:
        first, last = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, z)
        word = lambda i: _short(text[tokens[i][0] : tokens[i][1]]) if 0 <= i < len(tokens) else "^"
        contexts = [f"2 {word(first - 2)} {word(first - 1)}", f"1 {word(first - 1)} _ {word(last)}"]
        out.append((a, z, kind, _short(text[a:z]), contexts))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_ROW = pa.schema([("part", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("filler", pa.string()), ("contexts", pa.list_(pa.string()))])
_COLUMNS = "part string, row long, doc_id long, base array<struct<kind:int,start:long,end:long>>, start long, end long, kind int, filler string, contexts array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: base spans of each document, and occurrences of seeds and candidates."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                rows, bases, occ = [], [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    rows.append(row)
                    bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                    occ += [(row, *o) for o in occurrences(text or "", base)]
                    row += 1
                n = len(rows)
                yield batch(_ROW, ["document"] * n, rows, part.column(0), bases, *(pa.nulls(n, f.type) for f in list(_ROW)[4:]))
                if occ:
                    r, s, e, k, w, c = map(list, zip(*occ))
                    yield batch(_ROW, ["occurrence"] * len(r), r, pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.list_(_SPAN)), s, e, k, w, c)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), _COLUMNS)


def confident_contexts(occurring: DataFrame, *, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """context, kind, score of the contexts that discover.

    occurring has context, filler, kind (null: unknown).  Each edge of the graph
    counts once however often it occurs, so a filler that is repeated in a third of
    all documents has no more say than another.
    """
    edges = stored(occurring.groupBy("context", "filler").agg(F.max("kind").alias("kind")))
    edges = stored(edges.join(edges.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support), "context"))
    known = edges.filter("kind IS NOT NULL").select("context", "filler", "n", "kind", F.lit(1.0).alias("score"))
    unknown = edges.filter("kind IS NULL").select("context", "filler", "n")
    scored, contexts = known, None
    for k in range(rounds):
        contexts = stored(scored.groupBy("context", "n", "kind").agg((F.sum("score")).alias("s")).select("context", "kind", "n", (F.col("s") / (F.col("n") + DAMPING)).alias("score")))
        if k + 1 < rounds:
            reach = unknown.join(contexts.select("context", "kind", "score"), "context")
            fillers = reach.groupBy("filler", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)) * 0.9)))).alias("score"))
            fillers = stored(fillers.groupBy("filler").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best")).select("filler", "best.*"))
            scored = known.unionByName(unknown.join(fillers, "filler").select("context", "filler", "n", "kind", "score"))
    best = contexts.groupBy("context").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best")).select("context", "best.*")
    return best.filter(F.col("score") >= confident)


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row's text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns),
    base_sha256, spans, n_found (spans that contexts discovered), n_secret
    (key-like strings) and n_spans (all).  A null text is empty; repeated rows each
    have their own row, as have rows without id.  An empty table gives an empty
    result; other columns do not matter.
    """
    with passing(docs.sparkSession) as keep:
        documents, occ = stored_by(scan(docs), "part", ("document", "occurrence"))
        rows = keep(documents)
        contexts = stored(confident_contexts(occ.select("kind", "filler", F.explode("contexts").alias("context"))))
        # base spans and secrets are in the result anyway
        open_ = occ.filter("kind IS NULL").select("row", "start", "end", F.explode("contexts").alias("context"))
        found = open_.join(contexts, "context").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        found = found.withColumn("found", F.lit(True)).unionByName(occ.filter("kind = 4").select("row", "start", "end", "kind", F.lit(False).alias("found")))
        added = keep(stored(found.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "found")).alias("added"))))
    out = rows.select("row", "doc_id", "base").join(added, "row", "left")
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    more = F.coalesce(F.col("added"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint,found:boolean>>"))
    every = F.array_sort(F.concat("base", F.transform(more, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    among = lambda name, holds: F.size(F.filter(more, holds)).cast("long").alias(name)
    return out.select(
        "doc_id", *map(count, range(4)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
        among("n_found", lambda s: s["found"]), among("n_secret", lambda s: s["kind"] == 4), F.size(every).cast("long").alias("n_spans"),
    )


def hidden_recall(docs: DataFrame, *, share: int = 5) -> DataFrame:
    """kind, hidden, found: how many occurrences of seeds contexts bring back when one in share of the seeds is hidden.

    A hidden seed is treated as an unknown candidate wherever it occurs, and must be
    given its own kind again.
    """
    _, occ = stored_by(scan(docs), "part", ("document", "occurrence"))
    hide = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("filler"), F.lit(share)) == 0)
    occ = occ.select("row", "start", "end", "filler", "contexts", F.col("kind").alias("truth"), hide.alias("hidden"), F.when(~hide, F.col("kind")).alias("kind"))
    edges = occ.select("row", "start", "end", "truth", "hidden", "kind", "filler", F.explode("contexts").alias("context"))
    contexts = stored(confident_contexts(edges.select("context", "filler", "kind"))).withColumnRenamed("kind", "told")
    told = edges.filter("hidden").join(contexts, "context").groupBy("row", "start", "end").agg(F.max_by("told", F.struct("score", "told")).alias("told"))
    names = F.array(*map(F.lit, KINDS))
    asked = occ.filter("hidden").join(told, ["row", "start", "end"], "left")
    return asked.groupBy(F.element_at(names, F.col("truth") + 1).alias("kind")).agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("told") == F.col("truth")).alias("found"))
