"""Operator 9 against a plain version."""

import random
import tracemalloc
import unittest.mock as m

import numpy as np
import pyarrow as pa

from tests.llm import brute

from skyquarry.llm import repeats


def held(spark, docs):
    frame = spark.createDataFrame([(d, t, "clash", b"x") for d, t in docs], "doc_id long, text string, doc string, same binary")
    with m.patch.object(repeats, "BUCKET_BYTES", 60_000), m.patch.object(repeats, "GROUP_BYTES", 50_000):
        found = repeats.deduplicated(frame).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute.repeats(docs)


def test_real(spark):
    held(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_odd_rows(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ij é") for _ in range(300))
    docs = [(50, None), (49, ""), (48, "short"), (47, "short"), (46, "x" * 49), (45, "x" * 49), (44, "x" * 50), (43, "x" * 51), (42, "x" * 5000), (41, "ab" * 400), (40, "ba" * 300)]
    docs += [(i, passage[rng.randrange(200) :] + "".join(rng.choice("pqr") for _ in range(rng.randrange(80))) + passage[: rng.randrange(300)]) for i in range(30)]
    docs += [(60, passage), (60, passage), (60, passage + "!"), (61, passage), (-5, passage[20:90]), (62, passage[:50]), (63, passage[1:51]), (64, passage[:49])]
    held(spark, docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.deduplicated(empty).collect() == []
    no_id = spark.createDataFrame([(None, passage), (1, passage + "z"), (None, passage + "y")], "doc_id long, text string")
    got = {r.n_bytes: r.n_removed for r in repeats.deduplicated(no_id).collect()}
    n = len(passage.encode())
    # rows without an id count as one document, larger than all others
    assert got == {n: n, n + 1: 0} or sorted((r.n_bytes, r.n_removed) for r in repeats.deduplicated(no_id).collect()) == [(n, n), (n + 1, 0), (n + 1, n)]


def test_families_of_near_copies(spark):
    rng = random.Random(4)
    base = [rng.choice(["the", "thing", "on", "of", "er", "and", "shion"]) + rng.choice(["", "s", "ed"]) for _ in range(400)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(400)] = "zz%d" % rng.randrange(50)
        a = rng.randrange(300)
        docs.append((rng.randrange(10**12), " ".join(words[a : a + rng.randrange(20, 200)])))
    held(spark, docs)


def test_frequent_lines(spark, monkeypatch):
    """Lines that most documents have, alone and amid others, by windows of their own."""
    monkeypatch.setattr(repeats, "LEAST_FREQUENT", 5)
    monkeypatch.setattr(repeats, "FREQUENT", 20)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    lines = ["This line is in nearly every document of all, word for word, ümlauts too.", "x" * 70, "ab" * 60]
    docs = []
    for i in range(400):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4))]
        for line in lines:
            if rng.random() < 0.7:
                parts.insert(rng.randrange(len(parts) + 1), line if rng.random() < 0.8 else line[rng.randrange(8) :])
        docs.append((rng.randrange(10**9), " ".join(parts)))
    docs += docs[:20]
    held(spark, docs)


def test_packed_tuples_come_back():
    """Buckets that lie in several batches, or several in one, with rows that have none of a column."""
    rng = np.random.default_rng(3)
    bucket, doc = rng.integers(0, 5, 1000), rng.integers(-(2**62), 2**62, 1000)
    columns = {"gram": rng.integers(0, 256, (1000, repeats.PART), dtype=np.uint8), "doc": doc, "nth": rng.integers(0, 9, 1000).astype(np.int32)}
    rows = pa.concat_tables([repeats._dealt(bucket[x:y], {k: v[x:y] for k, v in columns.items()}, "bucket") for x, y in ((0, 300), (300, 310), (310, 1000))])
    rows = pa.concat_tables([rows, pa.table({"bucket": pa.array([2, 5], pa.int32()), "doc": pa.array([None, np.int64(7).tobytes()])})], promote_options="default").sort_by("bucket")
    n = len(rows)
    for cuts in ((0, n), (0, 4, n), tuple(range(n + 1))):
        batches = [b for x, y in zip(cuts, cuts[1:]) for b in rows.slice(x, y - x).combine_chunks().to_batches()]
        found = list(repeats._per_bucket(iter(batches), {"gram": np.uint8, "doc": np.int64, "nth": np.int32}))
        assert len(found) == 6 and found[5]["doc"].tolist() == [7] and not len(found[5]["gram"])
        for b in range(5):
            assert sorted(zip(found[b]["doc"].tolist(), found[b]["nth"].tolist(), map(bytes, found[b]["gram"].reshape(-1, repeats.PART)))) == sorted(zip(doc[bucket == b].tolist(), columns["nth"][bucket == b].tolist(), map(bytes, columns["gram"][bucket == b])))


def peak(work) -> float:
    """MB that Python and numpy hold at most while ``work`` runs."""
    work()  # what is kept between chunks is there already
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_memory_of_a_worker():
    """Two workers share with their JVM what an executor has; a batch of texts and a bucket of each kind (of a sixth of
    BUCKET_BYTES here) need little beside themselves."""
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(500)]
    texts += [t[:3000] + "x" + t[3000:] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    none = np.zeros(0, dtype=np.uint64)
    run = lambda made: sum(len(b) for b in made)
    assert peak(lambda: run(repeats.frequent(iter([batch]), 1000))) < 25
    assert peak(lambda: run(repeats.sampled(iter([batch]), 3, none))) < 25
    bucket = pa.Table.from_batches(repeats.sampled(iter([batch]), 1, none)).combine_chunks().to_batches()
    assert peak(lambda: run(repeats.shared(iter(bucket), 2))) < 5 * bucket[0].nbytes / 1e6
    met = pa.concat_tables([pa.Table.from_batches([b]) for b in repeats.shared(iter(bucket), 1)])
    group = pa.table({"doc": batch["doc"], "row_key": batch["doc"], "text": batch["text"]})
    sides = repeats.surrounded(group, met, 1, none, 0).combine_chunks().to_batches()
    assert peak(lambda: run(repeats.induced(iter(sides), 2))) < 2.3 * sides[0].nbytes / 1e6
