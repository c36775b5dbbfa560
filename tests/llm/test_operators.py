"""Each operator against a brute-force version on a small table with every awkward case."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from obscat.llm import (
    bloom_lm, curriculum_mix, exact_fingerprint, partenum_join, pii_bootstrap, prefix_fingerprint, rank_bpe, subword_quality, suffix_dedup, suffixes, warc_segments,
)

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, count long, label int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(i, text(rnd.randrange(1, 80))) for i in range(60)]
    for i in range(60, 80):  # near copies of one text
        w = base.split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(80, base.upper()), (81, base), (82, ""), (83, None), (84, " \t\n"), (85, "a"), (86, "A"), (87, "one two three"), (88, "x" * 900), (89, "ab" * 400 + passage), (90, passage + text(5) + passage)]
    rows += [(91, text(9000)), (91, "same id, other text"), (92, base), (92, base), (None, base), (None, None), (93, "é" * 300), (94, "mail a.b@c.de and b@d.fr%x@y.zz 10.0.0.1 300.1.1.1 +1 (555) 010-9999 4111 1111 1111 1111")]
    rnd.shuffle(rows)
    sources = ["s1", "s2", None, "s0"]
    return [(i, t, "en", sources[k % 4], len(t or ""), None, None, None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("moduli", [exact_fingerprint.MODULI, ((7, 3), (5, 2))])
def test_exact_dedup(docs, table, moduli):
    """With tiny moduli most fingerprints clash, and the chunks tell the texts apart."""
    groups = {}
    for i, t, *_ in table:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    expected = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = set()
        for i in ids:
            expected.append((i, keep, len(ids), i == keep and i not in done, hashlib.sha256(t.encode()).hexdigest()))
            done.add(i)
    got = exact_fingerprint.exact_dedup(docs, chunk=64, moduli=moduli)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == ordered(expected)


def test_fingerprints_compose():
    fp = exact_fingerprint.Fingerprinter(16)
    data = bytes(random.Random(1).randrange(256) for _ in range(1000))
    for k in (0, 1):
        prime, base = exact_fingerprint.MODULI[k]
        plain = 0
        for b in data:
            plain = (plain * base + b + 1) % prime
        assert fp.combine([(h[k], n) for h, n in fp.chunk_hashes(data)], k) == plain


def test_quality(spark, docs):
    rnd = random.Random(5)
    good = lambda: " ".join(rnd.choice(["the", "of", "house", "river", "green", "walks"]) for _ in range(40))
    junk = [lambda: " ".join(rnd.choice(["&&&", "***", "$$$"]) + rnd.choice("abc") for _ in range(40)), lambda: " ".join([rnd.choice(["river", "house", "green"])] * 40)]
    rows = [(i, rnd.choice(junk)() if i % 4 == 0 else good(), i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = subword_quality.fit(d, labels)
    got = subword_quality.score(d, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert subword_quality.score(docs, model).count() == docs.count() and subword_quality.keep_good(docs, model).columns == docs.columns
    assert [r.score for r in subword_quality.score(d, subword_quality.train([])).limit(2).collect()] == pytest.approx([1.0, 1.0])
    alone = model.scores([b"river house", b"", b"&&&a"])
    assert alone == pytest.approx([model.scores([t])[0] for t in (b"river house", b"", b"&&&a")])


def test_warc(spark, tmp_path):
    rnd = random.Random(3)
    html = lambda n: "".join(rnd.choice("<p>ñé\r\n0") for _ in range(n))
    big = html(90000)
    pages = [(1, "u", big, 1), (2, "u\r\nx", big, 1), (3, None, "", 1), (4, "u", None, 1), (5, "u", "small", 1), (6, "u", "small", 1), (7, "u", html(500), 1), (7, "u", big, 1), (0, "u", html(16384), 1), (None, "u", big, 1), (8, "u", "WARC/1.1\r\n\r\n" * 30, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long").repartition(2)
    expected = []
    for i, _, t, _ in pages:
        b = (t or "").encode()
        same = [j for j, _, u, _ in pages if (u or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= 100 else None
        revisit = first is not None and i != first
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert rows_of(warc_segments.archive_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == ordered(expected)
    assert warc_segments.archive_round_trip(df.limit(0)).count() == 0


def test_warc_segments():
    payload = bytes(range(256)) * 40
    ident = "urn:uuid:1"
    parts = warc_segments.page_records(ident, 1, "u", payload, hashlib.sha256(payload).hexdigest(), None, segment=1000)
    found = [*warc_segments.parse(b"".join(p + b"\r\n\r\n" for p in parts))]
    assert len(found) == len(parts) > 5 and found[0][0]["warc-segment-number"] == "1" and found[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in found))
    assert warc_segments.unchunked(b"".join(b for _, b in found).partition(b"\r\n\r\n")[2]) == payload
    with pytest.raises(ValueError):
        [*warc_segments.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")]


def test_warc_problems(spark):
    payload = "".join(f"x{i}" for i in range(700)).encode()
    digest = hashlib.sha256(payload).hexdigest()
    blocks = [b for p in warc_segments.page_records("urn:uuid:1", 1, "u", payload, digest, None, segment=1000) for _, b in warc_segments.parse(p + b"\r\n\r\n")]
    total = sum(map(len, blocks))
    cases = {"a": (blocks, total, None), "b": (blocks[:1] + blocks[2:], total, "segment is missing"), "c": (blocks, total + 1, "total length"), "d": ([b.replace(b"x", b"y") for b in blocks], total, "digest")}
    rows = []
    for origin, (bs, length, _) in cases.items():
        for b in bs:
            rows.append((origin, blocks.index(b) + 1 if b in blocks else bs.index(b) + 1, length if b is bs[-1] else None, "response", ord(origin), None, digest, None, bytearray(b)))
    got = warc_segments.reassembled(spark.createDataFrame(rows, warc_segments._RECORD).repartition(3)).collect()
    for r in got:
        wanted = cases[chr(r.page_id)][2]
        assert (r.problem is None) if wanted is None else wanted in r.problem


def test_mix(spark, docs, table):
    got = curriculum_mix.curriculum_mix(docs).collect()
    assert len(got) == len(table)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    left, open_, target = total, set(by), {}
    while True:  # the excess of capped sources goes to the others, until none is above
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(target[s]) and sum(r.taken for r in rs) == pytest.approx(target[s], abs=0.51) and rs[0].source_size == sizes[s]
    order = [r.position for r in curriculum_mix.training_order(curriculum_mix.curriculum_mix(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in got)


def test_schedules():
    for slope in curriculum_mix.SLOPES:
        for t in (0.0, 0.25, 0.5, 1.0):
            f = (1 - slope) * t + slope * t * t
            one = 1 - slope
            assert (f if slope == 0 else (math.sqrt(one * one + 4 * slope * f) - one) / (2 * slope)) == pytest.approx(t)


def test_prefix_fingerprints(docs, table):
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in table))
    powers = prefix_fingerprint.Powers()
    hashed = lambda text: prefix_fingerprint.PrefixHash(prefix_fingerprint.points(text), powers)
    expected, prints = [], {}
    for k, (known, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        near = []
        for o in (edited, nxt):
            spans = hashed(t).common_spans(hashed(o))
            assert all(t[x : x + m] == o[y : y + m] for x, y, m in spans)
            assert all(x + m <= x2 and y + m <= y2 for (x, y, m), (x2, y2, _) in zip(spans, spans[1:]))
            front = next((j for j in range(min(len(t), len(o))) if t[j] != o[j]), min(len(t), len(o)))
            covered = sum(m for *_, m in spans)
            assert front <= covered <= min(len(t), len(o))
            near.append(round(covered / max(len(t), len(o)), 9) if t or o else 1.0)
        expected.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
    got = prefix_fingerprint.document_fingerprints(docs)
    assert rows_of(got.withColumn("a", F.round("near_edited", 9)).withColumn("b", F.round("near_next", 9)), "doc_id", "n_chars", "edited_sha256", "a", "b") == ordered(expected)
    for r in got.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").filter("doc_id <> 91").collect():
        assert prints.setdefault(r.t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_inner_spans():
    """What both texts have between other things is found, whatever stands at their ends."""
    powers, rnd = prefix_fingerprint.Powers(), random.Random(4)
    hashed = lambda text: prefix_fingerprint.PrefixHash(prefix_fingerprint.points(text), powers)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    assert hashed("x" + "a" * 998 + "y").likeness(hashed("z" + "a" * 998 + "q")) == 0.998
    for _ in range(30):
        parts = [text(rnd.randrange(300, 900)) for _ in range(3)]
        whole, moved = text(200).join(["", *parts, ""]), text(50).join(["", *parts, ""])
        assert hashed(whole).likeness(hashed(moved)) >= sum(map(len, parts)) / len(whole) - 0.02
        a, b = (hashed(x).digest() for x in (whole, moved))
        assert prefix_fingerprint.likeness_of_fingerprints(a, a) == 1.0 and 0 <= prefix_fingerprint.likeness_of_fingerprints(a, b) <= 1
    base = text(4000)
    a, b, c = (hashed(x).digest() for x in (base, base[:2000] + "#" + base[2000:], text(4000)))
    assert prefix_fingerprint.likeness_of_fingerprints(a, b) > 0.6 and prefix_fingerprint.likeness_of_fingerprints(a, c) < 0.1
    assert prefix_fingerprint.likeness_of_fingerprints(hashed("").digest(), hashed("").digest()) == 1.0


def test_blocks_of_prefix_hashes(monkeypatch):
    """Arrays made block by block are those made at once."""
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1000))
    whole = prefix_fingerprint.PrefixHash(prefix_fingerprint.points(text), prefix_fingerprint.Powers())
    monkeypatch.setattr(prefix_fingerprint, "BLOCK", 64)
    parts = prefix_fingerprint.PrefixHash(prefix_fingerprint.points(text), prefix_fingerprint.Powers())
    assert whole.digest() == parts.digest() and whole.places == parts.places


def test_spans():
    p = prefix_fingerprint.Powers()
    a, b = (prefix_fingerprint.PrefixHash(prefix_fingerprint.points(t), p) for t in ("abracadabra", "xxbracadxx"))
    assert a.forward(1, b, 2) == 6 and a.backward(7, b, 8, 9) == 6 and a.equal(0, a, 7, 4) and not a.equal(0, a, 3, 2)


@pytest.mark.parametrize("n,similar,few", [(4, (85, 100), 16), (5, (80, 100), 16), (2, (60, 100), 16), (2, (60, 100), 1)])
def test_jaccard_join(docs, table, n, similar, few, monkeypatch):
    monkeypatch.setattr(partenum_join, "FEW", few)
    expected = components_of(table, n, similar)
    assert rows_of(partenum_join.similar_documents(docs, n=n, similar=similar), "doc_id", "n_shingles", "component_id") == ordered(expected)


@pytest.mark.parametrize("few", [16, 1])
def test_families_about_the_threshold(spark, few, monkeypatch):
    """Variants of one text at all distances, so that similar ones often meet only at a text that is like neither."""
    monkeypatch.setattr(partenum_join, "FEW", few)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for family in range(3):
        base = [word() for _ in range((40, 90, 160)[family])]
        stems = [base]
        for _ in range(30):
            w = list(rnd.choice(stems))
            for _ in range(rnd.randrange(1, 5)):
                w[rnd.randrange(len(w))] = word()
            stems.append(w)
        rows += [(family * 100 + k, " ".join(w)) for k, w in enumerate(stems)]
    rnd.shuffle(rows)
    expected = components_of(rows, 3, (80, 100))
    got = partenum_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=3, similar=(80, 100))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == ordered(expected)
    assert 5 < len({c for *_, c in expected}) < 90


def components_of(table, n, similar):
    """doc_id, size of the set, least id of the component, by comparing all pairs."""
    num, den = similar
    sets = []
    for i, t, *_ in table:
        w = words(t)
        sets.append((i, frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = [*range(len(sets))]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(x)] = root(y)
    comps = {}
    for k, (i, _) in enumerate(sets):
        comps.setdefault(root(k), []).append(i)
    return [(i, len(s), min((j for j in comps[root(k)] if j is not None), default=None)) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("window,gram", [(100, 36), (20, 12)])
def test_substring_dedup(docs, table, window, gram):
    unique = {i for i, *_ in table if sum(j == i for j, *_ in table) == 1 and i is not None}
    d = docs.filter(F.col("doc_id").isin(*unique))
    seen, expected = set(), []
    for i, t in sorted((i, (t or "").encode()) for i, t, *_ in table if i in unique):
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            if w in seen:
                gone[p : p + window] = [True] * window
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.substring_dedup(d, window=window, gram=gram, block=3000)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(expected)
    assert suffix_dedup.substring_dedup(docs, window=window, gram=gram).count() == len(table)


def test_substring_order_of_rows(spark):
    """Rows without id come last, and rows of one id follow each other as they are read: the later ones lose what repeats."""
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdef ") for _ in range(150))
    rows = [(None, "x" + shared), (7, shared + "y"), (7, "zz" + shared), (3, "q" + shared + "r"), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.substring_dedup(df, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted([(0, 151, 150, 1), (7, 151, 150, 1), (7, 152, 150, 1), (3, 152, 0, 0), (0, 150, 150, 1)])


def test_long_texts(spark):
    """A text of some megabytes goes through every operator whole, beside a short one, an empty one and a null."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(5000)]
    text = " ".join(rnd.choice(vocabulary) for _ in range(400_000))
    assert len(text) > 2_000_000
    df = spark.createDataFrame([(1, text, "a"), (2, "short", "a"), (3, "", "b"), (4, None, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    n = text.count(" ") + 1
    assert exact_fingerprint.exact_dedup(df).filter("doc_id = 1").first().text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bloom_lm.lm_scores(df).filter("doc_id = 1").first().n_tokens == n + 1
    assert curriculum_mix.mix_report(df).filter("doc_id = 1").first()["size"] == n
    assert prefix_fingerprint.document_fingerprints(df).filter("doc_id = 1").first().n_chars == len(text)
    assert suffix_dedup.substring_dedup(df).filter("doc_id = 1").first().n_bytes == len(text)
    assert partenum_join.similar_documents(df).filter("doc_id = 1").first().n_shingles > 0.9 * n
    for result in (subword_quality.classify(df, labels), pii_bootstrap.personal_data(df), rank_bpe.bpe_digests(df, VOCABULARY)):
        assert result.count() == 4


def test_suffix_sorting():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(150):
        letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
        data = np.frombuffer(b"\0".join(bytes(ord(rnd.choice(letters)) for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 6))) + b"\0", np.uint8)
        depth = rnd.choice([5, 8, 12, 20])
        order = suffixes.two_stage(data, np.array([0]), np.array([len(data)]), depth)
        raw = bytes(data) + bytes(depth)
        cut = [raw[p : p + depth] for p in order]
        assert sorted(order.tolist()) == [*range(len(data))] and cut == sorted(cut)
        shared = [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(cut, cut[1:])]
        assert suffixes.common_prefixes(data, order, depth).tolist() == shared


def test_language_model(docs, table):
    toks = [(i, [*words(t), None]) for i, t, *_ in table]
    learnt = [w for i, w in toks if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = {}
    for w in learnt:
        for x in w:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    base = lambda w: round(sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)
    expected = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(x in c for x in w), n, base(w)) for i, w in toks]
    got = bloom_lm.lm_scores(docs, block=4000)
    assert rows_of(got.withColumn("b", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b") == ordered(expected)
    assert all(r.score < 0 for r in got.collect())


def test_filter_levels():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 60, 3000, dtype=np.uint64)
    counts = np.random.default_rng(2).integers(1, 5000, 3000)
    data, least = bloom_lm.segment(keys, counts, 1 << 20)
    f = bloom_lm.LogFrequencyFilter(data, 1, 1 << 20)
    read = f.level(keys, np.zeros(3000, np.uint64))
    assert least == 1 and (read >= bloom_lm.levels(counts)).all() and (read == bloom_lm.levels(counts)).mean() > 0.97
    _, least = bloom_lm.segment(keys, counts, 1 << 14)
    assert least > 1


def test_language_model_keeps_all(spark):
    """A range with more n-grams than a filter of fixed size would hold reads every one of them."""
    import numpy as np

    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 60, 3_200_000, dtype=np.uint64))
    counts = np.where(np.arange(len(keys)) % 10, 1, 3).astype(np.uint32)
    rows = [("word", 0, 0, bytearray(bloom_lm.pack(np.diff(keys, prepend=np.uint64(0)))), bytearray(bloom_lm.pack(counts)))]
    rows += [("word", 1, 0, bytearray(bloom_lm.pack(np.diff(keys[:5], prepend=np.uint64(0)))), bytearray(bloom_lm.pack(np.zeros(5, np.uint32))))]
    back = bloom_lm.counted(spark.createDataFrame(rows, "kind string, block long, part int, keys binary, counts binary"), exact=True)
    got = {r.block: r for r in back.collect()}
    read = bloom_lm.unpack(got[0].levels, np.uint8)
    assert (got[None].total, got[None].distinct) == (int(counts.sum()), len(keys))
    assert (read >= bloom_lm.levels(counts)).all() and (read == bloom_lm.levels(counts)).mean() > 0.99


def test_language_model_scores(docs, table):
    """The pair model against counts that are quantised without a filter."""
    import numpy as np

    toks = [(i, [*words(t), None]) for i, t, *_ in table]
    one, two = {}, {}
    for i, w in toks:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            for a, b in zip(["", *w], w):
                one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    total, stands = sum(one.values()), bloom_lm.level_counts()
    quant = lambda counts, k: float(stands[bloom_lm.levels(np.array([counts.get(k, 0)]))[0]])
    left = bloom_lm.DISCOUNT * len(two) / total

    def score(w):
        out = 0.0
        for a, b in zip(["", *w], w):
            context = quant(one, a or None)
            share = min(1.0, max(quant(two, (a, b)) - bloom_lm.DISCOUNT, 0) / max(context, 1)) if context else 0.0
            out += math.log10(share + left * (quant(one, b) + 0.5) / (total + 0.5 * (len(one) + 1)))
        return out

    expected = sorted((i is not None, i or 0, len(w), score(w)) for i, w in toks)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score) for r in bloom_lm.lm_scores(docs, block=4000).collect())
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert sum(abs(g[3] - e[3]) for g, e in zip(got, expected)) < 0.01 * sum(e[2] for e in expected)


VOCABULARY = rank_bpe.vocabulary("word_bpe_49k.json")


def test_bpe(docs, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    expected = []
    for i, text, *_ in table:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(rank_bpe.bpe_digests(docs, VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(expected)


def test_bpe_texts():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(VOCABULARY), rank_bpe.WordBpe(VOCABULARY)
    rnd = random.Random(2)
    texts = ["", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ", "don't WE'LL I'm", "é é", "x" * 5000, "ab" * 3000, "!?" * 300, "日本語", "\x85\xa0 a", "ß1٣½"]
    texts += ["".join(rnd.choice("abcdeßé '.<|>1 \n") for _ in range(rnd.randrange(120))) for _ in range(300)]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids) == t.decode(ids, skip_special_tokens=False)
    for n in (1, 2, 5, 30):  # both ways of merging agree
        raw = bytes(rnd.choice(b"thelovering") for _ in range(n))
        ids = [*mine.inner[[*raw[:-1]]].tolist(), int(mine.last[raw[-1]])]
        assert mine.merge_together([raw])[0].tolist() == mine.merge_heap(ids)


def test_bpe_decodes_its_ids():
    """A word that is given another's ids shows in the decoded text."""
    mine = rank_bpe.WordBpe(VOCABULARY)
    mine.encode("house river")
    other = next(w for w in mine.young if w.strip() == "river")
    mine.young[next(w for w in mine.young if w.strip() == "house")] = mine.young[other]
    n, ids, decoded = mine.rows(["house", "", "river<|endoftext|>"])
    assert decoded == [mine.decode(mine.encode("river")), "", mine.decode(mine.encode("river<|endoftext|>"))] and n[1] == 0 and ids[1] == b""


def test_personal_data(docs, table):
    def spans(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii_bootstrap.luhn(re.sub("[ -]", "", m[0]))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]

    digest = lambda s: hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in s).encode()).hexdigest()
    counts = lambda s: [sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")]
    expected = [(i, *counts(s), digest(s)) for i, t, *_ in table for s in [spans(t or "")]]
    got = pii_bootstrap.personal_data(docs)
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == ordered(expected)
    for r in got.collect():  # spans are in order, in the text, and those of the base are among them
        told = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in r.spans.split(",") if x)]
        assert told == sorted(told, key=lambda s: (pii_bootstrap.KINDS.index(s[0]), *s[1:])) and len(told) == r.n_spans
        assert sum(k == "secret" for k, *_ in told) == r.n_secret
    rnd = random.Random(3)
    for _ in range(5000):
        t = "".join(rnd.choice("ab1.2@-_%+ 9()5") for _ in range(rnd.randrange(1, 40)))
        assert pii_bootstrap.base_spans(t) == [(pii_bootstrap.KINDS.index(k), a, z) for k, a, z in spans(t)]


def test_contexts_discover(spark):
    rows = [(i, f"filler{i} my card number {4000000000000000 + k} ends") for i, k in enumerate(x for x in range(100) if pii_bootstrap.luhn(str(4000000000000000 + x)))]
    rows += [(1000, "my card number 99887766-XY ends"), (1001, "version 2024.05 of the thing"), (1002, None)]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == "card:15:26" and got[1001] == "" and got[1002] == "" and got[0].startswith("card:")


def test_hidden_seeds_come_back(spark):
    """Of one in five seeds that are hidden, contexts that only seeds of one kind fill bring back nine in ten; seeds without such contexts stay hidden."""
    rnd = random.Random(6)
    ask = {"email": lambda i: f"write to user{i:04d}@mail{i % 7}.example.com please", "ip": lambda i: f"seen from {i % 250}.{i * 7 % 250}.11{i % 10}.{i % 200} today", "phone": lambda i: f"call us at +39051{100000 + i} now", "secret": lambda i: f"token = {hashlib.md5(str(i).encode()).hexdigest()} end"}
    rows = [(n * 1000 + i, f"w{rnd.randrange(10**6)} " + f(i)) for n, f in enumerate(ask.values()) for i in range(150)]
    found = {r.kind: r.found / r.hidden for r in pii_bootstrap.hidden_recall(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found.keys() == ask.keys() and min(found.values()) >= 0.9
    alone = [(i, f"w{i} u{i}@a{i}.com v{i}") for i in range(60)]
    assert all(r.found == 0 for r in pii_bootstrap.hidden_recall(spark.createDataFrame(alone, "doc_id long, text string")).collect())


def test_secrets(spark):
    rows = [(1, "x 9233A8ECF7C5B09FE5949719B6B82BC439E9329B y"), (2, "d41d8cd98f00b204e9800998ecf8427e"), (3, "no 1234567890123456789012345678901234 here"), (4, "Mixed9233A8ecf7c5b09fe5949719b6b82bc439e9329b")]
    got = {r.doc_id: (r.spans, r.n_secret) for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("secret:2:42", 1), 2: ("secret:0:32", 1), 3: ("", 0), 4: ("", 0)}


def test_discovered_entities_seed_contexts(spark):
    """Staff numbers are found beside phone numbers, then beside 'badge no', where no seed ever stands."""
    rows = [(i, f"reach me via +1555010{1000 + i} anytime") for i in range(200)]
    rows += [(1000 + i, f"reach me via QX-{70000 + i} anytime") for i in range(8)]
    rows += [(2000 + i, f"holder of badge no QX-{70000 + i} here") for i in range(8)]
    rows += [(3000, "holder of badge no QX-99123 here"), (3001, "part of item no ZZ-99124 there")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == "phone:13:21" and got[2000] == got[3000] == "phone:19:27" and got[3001] == ""


def test_empty_tables(empty):
    for df in (
        exact_fingerprint.exact_dedup(empty), subword_quality.classify(empty, empty.select("doc_id", F.lit(1).alias("quality"))), curriculum_mix.mix_report(empty), prefix_fingerprint.document_fingerprints(empty),
        partenum_join.similar_documents(empty), suffix_dedup.substring_dedup(empty), bloom_lm.lm_scores(empty), rank_bpe.bpe_digests(empty, VOCABULARY), pii_bootstrap.personal_data(empty),
    ):
        assert df.count() == 0
