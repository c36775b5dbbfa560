"""The corpus pipeline and each of its stages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from obscat.llm import curriculum_mix, rank_bpe, subword_quality

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = rank_bpe.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with copies, near copies, repeated ids, nulls and empty texts, of good and bad quality, and labels."""
    rnd = random.Random(7)
    good = lambda n: " ".join(rnd.choice("the of house river green walks tall sea over under stone bird".split()) for _ in range(n))
    junk = lambda: " ".join(rnd.choice(["&&&", "***", "$$$"]) + rnd.choice("abc") for _ in range(40))
    rows = [(i, junk() if i % 4 == 0 else good(rnd.randrange(20, 60))) for i in range(200)]
    base = good(80)
    for i in range(200, 215):
        w = base.split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "stone"
        rows.append((i, " ".join(w)))
    again = good(30)
    rows += [(220, base.upper()), (221, base), (222, again), (222, again), (222, good(40)), (223, again), (None, again), (None, None), (224, ""), (225, None), (226, good(30)), (226, base), (227, " \n"), (None, good(25))]
    rnd.shuffle(rows)
    rows = [(i, t, "en", ["s1", "s2", None, "s0"][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int").write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return P.table(spark, folder, "documents")


def lowered(text):
    return (text or "").translate(LOWER)


def plain(rows):
    return Counter(tuple(r) for r in rows)


def one_of_copies(rows):
    """Of each group of equal texts the greatest id stays, once."""
    best = {}
    for r in rows:
        best.setdefault(lowered(r.text), []).append(r.doc_id)
    return Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in best.items())


def one_of_near_copies(rows):
    """(id, texts that may stay) of each component: its smallest id, null last; rows without words stay."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(r.text))
        sets.append(frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    comp = [*range(len(rows))]
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if comp[x] != comp[y] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp = [comp[y] if c == comp[x] else c for c in comp]
    out = []
    for c in set(comp):
        ids = [r.doc_id for r, d in zip(rows, comp) if d == c]
        least = min((i for i in ids if i is not None), default=None)
        out.append((least, frozenset(r.text for r, d in zip(rows, comp) if d == c and r.doc_id == least)))
    return out


def fits(got, expected):
    """Whether the rows are one of each component."""
    left = list(expected)
    for r in got:
        k = next((k for k, (i, texts) in enumerate(left) if i == r.doc_id and r.text in texts), None)
        if k is None:
            return False
        left.pop(k)
    return not left


def in_mix_order(docs):
    """The id of each copy of each row, in order of position, id and copy."""
    order = curriculum_mix.training_order(curriculum_mix.curriculum_mix(docs), ranked=False).collect()
    return [r.doc_id for r in sorted(order, key=lambda r: (r.position, r.doc_id is not None, r.doc_id or 0, r.copy))]


def coded(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(VOCABULARY), Counter()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        digests = (hashlib.sha256(x).hexdigest() for x in (b"".join(i.to_bytes(4, "little") for i in ids), t.decode(ids, skip_special_tokens=False).encode()))
        out[r.doc_id, len(ids), *digests] += 1
    return out


def good_rows(spark, docs, folder):
    """Each text scored alone, by the model that the stage learns."""
    model = subword_quality.fit(docs, P.table(spark, folder, "labels"))
    return [r for r in docs.collect() if model.scores([(r.text or "").encode()])[0] >= subword_quality.THRESHOLD]


def test_good_quality(spark, docs, folder):
    expected, got = good_rows(spark, docs, folder), P.good_quality(spark, docs, folder)
    assert got.columns == docs.columns and plain(got.collect()) == plain(expected)
    assert 150 < len(expected) < docs.count() and any(r.text is None for r in expected)


def test_without_copies(spark, docs, folder):
    got, all_rows = P.without_copies(spark, docs, folder), plain(docs.collect())
    assert got.columns == docs.columns and not plain(got.collect()).keys() - all_rows.keys()
    assert Counter((r.doc_id, lowered(r.text)) for r in got.collect()) == one_of_copies(docs.collect())


def test_without_near_copies(spark, docs, folder):
    got = P.without_near_copies(spark, docs, folder)
    assert got.columns == docs.columns and fits(got.collect(), one_of_near_copies(docs.collect()))
    assert got.count() < docs.count()


def test_mixed(spark, docs, folder):
    got, expected = P.mixed(spark, docs, folder), in_mix_order(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == Counter(expected)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    n, copies = plain(docs.collect()), plain(got.collect())
    assert not copies.keys() - n.keys() and all(c <= 3 * n[r] for r, c in copies.items()) and max(copies[r] / n[r] for r in copies) > 1
    # taken words of each source, the one document that is taken in part aside
    for source in {r.source for r in docs.collect()}:
        target = curriculum_mix.curriculum_mix(docs).filter(F.col("source").eqNullSafe(F.lit(source))).first().target
        taken = sum(c * words(r[1]) for r, c in copies.items() if r[3] == source)
        assert target - 1 <= taken <= target + 90


def test_mixed_positions_ascend(spark, docs, folder):
    distinct = spark.createDataFrame([*{r.doc_id: r for r in docs.collect() if r.doc_id is not None}.values()], docs.schema)
    assert [r.doc_id for r in P.mixed(spark, distinct, folder).collect()] == in_mix_order(distinct)


def test_encoded(spark, docs, folder):
    assert plain(P.encoded(spark, docs, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == coded(docs.collect())


def test_run(spark, docs, folder):
    """All stages in their order, each on what the one before it gives."""
    left = one_of_copies(kept := good_rows(spark, docs, folder))
    one = P.without_copies(spark, P.good_quality(spark, docs, folder), folder)
    assert Counter((r.doc_id, lowered(r.text)) for r in one.collect()) == left and len(kept) > one.count()
    near = P.without_near_copies(spark, one, folder)
    assert fits(near.collect(), one_of_near_copies(one.collect()))
    expected = coded(P.mixed(spark, near, folder).collect())
    got = P.run(spark, folder)
    assert plain(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == expected and sum(expected.values())


CLASHES = ("id", "digest", "row", "once", "named", "_id", "_sha", "_at", "position", "copy", "tag", "label", "n", "a.b")


def test_clashing_columns(spark, docs, folder):
    """Columns of any names go through all stages but the last."""
    wide = docs
    for k, c in enumerate(CLASHES):
        wide = wide.withColumn(c, F.lit(k))
    for _, stage in P.STAGES[:-1]:
        got, plain_ = stage(spark, wide, folder), stage(spark, docs, folder)
        assert got.columns == wide.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain_.collect())
        assert all(r[len(docs.columns) :] == tuple(range(len(CLASHES))) for r in got.collect())


def test_empty(spark, docs, folder):
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
