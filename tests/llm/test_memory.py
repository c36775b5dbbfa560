"""What the operators leave behind on executors: Java heaps, Python workers and scratch files."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

import corpus_pipeline as P
from obscat.llm import partenum_join, rank_bpe
from obscat.llm.common import frugal, frugal_group, stored

VOCABULARY = rank_bpe.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i // 2 + k) % 90}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def whole_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_join_shrinks_heaps(spark, docs):
    before = whole_collections(spark)
    got = partenum_join.similar_documents(docs).count()
    assert got == 60 and whole_collections(spark) >= before + 5


def test_stages_shrink_heaps(spark, docs):
    before = whole_collections(spark)
    P.encoded(spark, docs, "")
    assert whole_collections(spark) > before


def test_workers_drop_what_other_tasks_kept(docs):
    def sizes(batches):
        for b in batches:
            yield b

    rank_bpe.loaded(VOCABULARY)
    kept = rank_bpe.loaded(VOCABULARY)
    [*frugal(sizes, "rank_bpe")([])]
    assert rank_bpe.loaded(VOCABULARY) is kept
    [*frugal(sizes)([])]
    other = rank_bpe.loaded(VOCABULARY)
    assert other is not kept
    frugal_group(lambda found: found)(None)
    assert rank_bpe.loaded(VOCABULARY) is not other


def test_scratch_files_are_plain(spark, docs):
    """No side files, so no chmod for them; damage is still noticed, by the checksums of pages."""
    at = stored(docs)
    folder = Path(urlparse(at._stored_at).path)
    assert sorted(map(tuple, at.collect())) == sorted(map(tuple, docs.collect())) and not [*folder.rglob("*.crc")]
    for path in folder.glob("part-*"):
        data = bytearray(path.read_bytes())
        data[60] ^= 1
        path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        at.collect()
