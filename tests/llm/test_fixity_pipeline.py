import os
import sys

import pytest
from pyspark.sql import functions as F

from forecourt.llm import fixity
from forecourt.llm.support import Work, shared_folder

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def records(spark):
    rows = spark.range(20_000).selectExpr("id AS page_id", "id * 700 AS offset", "700L AS length", "sha2(CAST(id AS STRING), 256) AS digest")
    return Work(spark).store(rows)


def differing(spark, records, replica):
    return sorted((r["page_id"], r["status"]) for r in fixity.audit(Work(spark), records, replica).collect())


def test_equal_replicas_end_at_the_root(spark, records):
    assert differing(spark, records, records.repartition(5)) == []


def test_damage_is_located(spark, records):
    changed = F.when(F.col("page_id").isin(0, 777, 19_999), F.lit("x")).otherwise(F.col("digest"))
    replica = records.withColumn("digest", changed).filter("page_id <> 5000").unionByName(
        spark.createDataFrame([(99, 20_000 * 700 + 5, 3, "y")], records.schema)
    )
    assert differing(spark, records, replica) == [(0, "changed"), (99, "extra"), (777, "changed"), (5000, "missing"), (19_999, "changed")]


def test_empty_and_taller_replicas(spark, records):
    none = records.limit(0)
    assert differing(spark, none, none) == []
    some = records.filter("page_id < 10")
    assert differing(spark, some, none) == [(i, "missing") for i in range(10)]
    assert len(differing(spark, some, records)) == 19_990


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (13, "u", None, 2), (13, "u", "x" * 3_000_000, 3), (13, "u", "x" * 3_000_000, 3), (50, None, "", 4)], "page_id long, url string, html string, offset int")
    rows = fixity.audit_damaged_replica(pages).collect()
    assert sorted((r["page_id"], r["status"]) for r in rows) == [(13, "changed")] * 3 + [(50, "missing")]
    assert fixity.audit_damaged_replica(pages.limit(0)).count() == 0


def test_intermediate_tables_need_a_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd_documents, no_documents):
    out = {}
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        path = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{path}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
        out[name] = path
    return out


def test_stages_of_the_pipeline(spark):
    """Each stage keeps what its operator keeps, checked against the stage's own input."""
    sf_dir = "/root/testdata/sf0.001"
    docs, work, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        after = work.store(stage(spark, docs, sf_dir))
        if name != "shard":
            assert set(after.columns) == set(corpus_pipeline.COLUMNS)
        seen[name] = (docs.select("doc_id", "text").collect(), after.select("doc_id", "text").collect())
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    from llm.test_near_dups import brute

    before, after = seen["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, _, kept in brute([tuple(r) for r in before]) if kept)
    from llm.test_texts import _plain

    items = [_plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = seen["decontaminate"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not any(t in _plain(r["text"]) for t in items))
    before, after = seen["mix"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["shard"]
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] in kept for r in before if labels.get(r["doc_id"]) == 1)
    assert all(i not in kept for i, q in labels.items() if q == 0)


def test_pipeline_of_odd_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder["odd"]).count() > 0
    assert corpus_pipeline.run(spark, folder["none"]).count() == 0
