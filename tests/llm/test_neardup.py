"""Operator 10 and the components against plain versions, and on odd rows."""

import random

from tests.llm import brute

from skyquarry.llm import components, neardup

SCHEMA = "doc_id long, text string, node string"


def held(spark, docs, k=4):
    found = neardup.classes(spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA), k=k).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in found)
    assert got == brute.components(docs, k)


def test_real(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    held(spark, docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = [(9, None), (8, ""), (7, " \n "), (6, "one two"), (5, "One  TWO"), (4, "one two three"), (3, "x" * 1000), (2, long), (1, long + " tail"), (11, "a b c d"), (12, "a b c d e"), (13, "A b c d")]
    docs += [(20 + i, s) for i, s in enumerate(s for n in (512, 1024, 4096) for s in brute.thue_morse(n))]
    held(spark, docs)
    twice = spark.createDataFrame([(1, "a b c d e f", "x")] * 2 + [(2, "a b c d e f", "x"), (None, "q r s t u v w", "x"), (3, None, "x")], SCHEMA)
    assert sorted(str(r.component_id) for r in neardup.classes(twice).collect()) == ["1", "1", "1", "3", "None"]
    assert len(neardup.clean(twice).collect()) == 3 and neardup.clean(twice).columns == twice.columns
    assert neardup.classes(twice.limit(0)).collect() == []


def test_chains_and_families(spark):
    rng = random.Random(5)
    docs, d = [], 0
    for size in (2, 3, 40, 150):
        words = [f"v{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            docs.append((d, " ".join(copy)))
            d += 1
            if rng.random() < 0.3:  # drift: a chain whose ends are not similar
                words = copy
    rng.shuffle(docs)
    held(spark, docs)
    held(spark, docs, 5)


def test_long_texts_and_hot_shingles(spark, monkeypatch):
    """Pairs across components: 200,000 words, a pair that shares none of its first shingles, and one phrase in all texts."""
    rng = random.Random(9)
    monkeypatch.setattr(neardup, "FIRST", 3)
    monkeypatch.setattr(neardup, "SALTED", 4)
    monkeypatch.setattr(neardup, "LEAST_OFTEN", 4)
    long = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    docs = [(0, " ".join(long)), (1, " ".join(long[9_000:])), (2, " ".join(long[:191_000])), (3, " ".join(long[100_000:]))]
    phrase = "the very same opening words of every text"
    for f in range(12):
        words = [f"f{f}x{i}" for i in range(60)]
        for k in range(6):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            docs.append((100 + 10 * f + k, f"{phrase} {' '.join(copy)}"))
    held(spark, docs)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components.roots(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.roots(spark.createDataFrame([], "a int, b int")).collect() == []
