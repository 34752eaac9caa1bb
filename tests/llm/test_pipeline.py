"""The pipeline, each stage against a plain version on the stage's own input."""

from collections import defaultdict

import duckdb
import pytest
from tests.llm import brute

import corpus_pipeline
from skyquarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(tables):
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:-1])
    assert tables[-1].columns == [*tables[0].columns, "shard", "slot"]


def test_quality_keeps_what_is_labelled_good(spark, tables):
    kept = {d for d, _ in rows(tables[1])}
    before = dict(rows(tables[0]))
    assert not any(brute.quality(before[d])[-1] for d in kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect() if not brute.quality(before[r.doc_id])[-1]}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert good <= kept and len(bad & kept) <= 0.1 * len(bad)


def test_near_duplicates(tables):
    assert {d for d, _ in rows(tables[2])} == {d for d, _, _, kept in brute.components(rows(tables[1]), 5) if kept}


def test_decontamination(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.decontaminate(rows(tables[2]), items)
    assert sorted(d for d, _ in rows(tables[3])) == sorted(d for d in found if not found[d][1])


def test_mix_is_near_its_targets(tables):
    size, mixed, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in tables[3].collect():
        n = len(brute.WORD.findall(r.text))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    times = defaultdict(int)
    for r in tables[4].collect():
        mixed[r.source] += len(brute.WORD.findall(r.text))
        times[r.doc_id] += 1
    want = brute.targets(size)
    assert max(times.values()) <= 3 and all(abs(mixed[s] - want[s]) <= largest[s] for s in want)


def test_shards(tables):
    assert sorted(rows(tables[5])) == sorted(rows(tables[4]))
    slots = defaultdict(list)
    for r in tables[5].collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_run_and_its_folder(spark, tables):
    assert sorted(rows(corpus_pipeline.run(spark, SF))) == sorted(rows(tables[-1]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    said = con.sql(queries.ORACLE_SQL[name])
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(map(tuple, ours.select(*said.columns).collect())) == sorted(said.fetchall())


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in any column, long texts, copies, equal ids, columns of clashing names, and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter(F.length("text") > 2000).first().text
    kinds = "doc_id long, text string, lang string, source string"
    odd = [(None, text + " no id", "en", "a"), (9001, None, None, None), (9002, "", "en", None), (9003, text, None, "a"), (9004, text, "en", None), (9004, text, "en", None), (9004, text + " another", "en", "a"), (9005, " ".join(f"w{i}" for i in range(60_000)), "en", "a")]
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, kinds))
    for c in ("shard", "slot", "row", "group", "size", "tokens", "text_key", "node", "component_id", "block", "distance", "kept", "n_words"):
        table = table.withColumn(c, F.lit("clash"))
    for n, part in enumerate((table, table.limit(0))):
        part.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{n}")
        assert out.columns == [c for c in table.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        got = out.collect()
        assert bool(got) is (n == 0) and all(r.row == "clash" and r.text for r in got)
        assert len({r.doc_id for r in got if r.text == text}) <= 1
