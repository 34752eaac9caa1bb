"""Operator 8 against a plain version, labels and odd rows."""

from tests.llm import brute

from skyquarry.llm import quality

ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\n\t", "en", "a"), (4, "one", "en", None), (5, "a b a b a b", "en", "a"), (6, "line\nline\n line\n\nline\n \n \n", "en", "a"),
    (7, "x" * 3_000_000, "en", "a"), (8, "w " * 400_000, "xx", "a"), (9, "é😀 #|<>$%&* é😀 #|<>$%&* é😀", "en", "a"), (9, "same id", "en", "a"), (9, "same id", "en", "a"), (10, "a\x0bb\x0cc\rd\xa0e f\x1cg", "en", "a"),
]


ODD += [(20 + i, "\n".join(s + "\nx y z " + s for s in brute.thue_morse(n)), "en", "a") for i, n in enumerate((512, 1024, 4096))]


def test_counts_and_verdicts(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id + 100, r.text, r.lang, r.source, "clash") for r in real] + [(*o, "clash") for o in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    found = quality.judged(docs).collect()
    assert len(found) == len(rows)
    want = sorted((d, *brute.quality(t)) for d, t, *_ in rows)
    assert sorted((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    clean = quality.clean(docs)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in found if r.kept)
    assert quality.judged(docs.limit(0)).collect() == []


def test_verdicts_follow_the_labels(spark):
    base = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in quality.op8(spark, base).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.999 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_estimate_matches_a_plain_one(spark):
    """The centre and scatter of one group, by plain concentration on the same bins."""
    import numpy as np

    rng = np.random.RandomState(1)
    x = np.round(np.concatenate([rng.normal(0.5, 0.1, (900, 4)), rng.normal(3, 0.05, (100, 4))]), 3)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, " + ", ".join(f"{p} double" for p in quality.PARTS))
    got = quality.estimates(rows).first()
    floors = np.array(list(quality.PARTS.values()))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    centre, inverse = q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)
    for _ in range(quality.STEPS):
        away = x - centre
        d = np.einsum("ni,ij,nj->n", away, inverse, away)
        ring = np.floor(np.log2(d + 2.0**-6) * quality.BINS_PER_OCTAVE)
        inner = np.array([(ring < r).sum() for r in ring])
        core = x[inner < quality.CORE * len(x)]
        centre = core.mean(axis=0)
        inverse = np.linalg.inv(np.cov(core.T, bias=True) * quality.consistency(quality.CORE, 4) + np.diag(floors**2))
    assert np.allclose(got.centre, centre, atol=1e-4) and np.abs(centre - 0.5).max() < 0.02
    assert np.allclose(got.inverse, [inverse[i, j] for i, j in quality._pairs()], rtol=1e-3, atol=1e-2)


def test_any_statistic_can_reject(spark):
    """Repeated lines alone, and a length of words that only the group's own scatter makes strange."""
    import random

    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(a, b)))
    line = lambda a, b: " ".join([word(a, b).capitalize(), *(word(a, b) for _ in range(59))])
    rows = [(i, "\n".join(line(4, 6) for _ in range(5)), "en", "a") for i in range(80)]
    rows.append((100, "\n".join("\n".join([line(4, 6)] + ["bcdef"] * 6) for _ in range(5)), "en", "a"))
    rows.append((101, "\n".join(line(7, 9) for _ in range(5)), "en", "a"))
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [d for d, r in sorted(found.items()) if not r.kept] == [100, 101]


def test_batches_of_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate((None, "", None))], "doc_id long, text string, lang string, source string").coalesce(1)
    assert [(r.n_words, r.base_failed, r.kept) for r in quality.judged(docs).collect()] == [(0, True, False)] * 3
