import zlib
from collections import defaultdict

from forecourt.llm.mixing import mix_sources
from forecourt.llm.sharding import byte_shards


def check_shards(docs, shards=8, slack=None):
    rows = byte_shards(docs, shards).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(sizes.values()) / shards
    slack = slack or max((r["size"] for r in rows), default=0)
    assert all(abs(sizes[i] - target) <= 0.02 * target + slack for i in range(shards))
    return rows


def test_shards_are_contiguous_and_balanced(documents):
    rows = check_shards(documents)
    of, size = defaultdict(set), defaultdict(int)
    for r in rows:
        of[r["text_crc32"]].add(r["shard"])
        size[r["text_crc32"]] += r["size"]
    small = 0.01 * sum(size.values()) / 8
    assert not any(len(s) > 1 for k, s in of.items() if size[k] <= small)  # small groups of equal texts stay together


def test_a_hot_text_is_split(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same text' ELSE concat('text number ', id) END AS text")
    check_shards(docs)


def test_odd_rows_in_shards(odd_documents, no_documents):
    check_shards(odd_documents)
    carried = byte_shards(odd_documents, carry=tuple(odd_documents.columns))
    assert carried.count() == odd_documents.count() and len(set(carried.columns)) == len(carried.columns)
    assert byte_shards(no_documents).count() == 0


def check_mix(docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sources = defaultdict(list)
    for r in rows:
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 2 * r["size"]
        sources[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    weights = dict(zip(sorted(sources, key=lambda s: (s is None, s)), [3, 1, 2] * len(sources), strict=False))
    size = {s: sum(r["size"] for r in of) for s, of in sources.items()}
    left, free, target = 1.5 * total, set(sources), {}
    while True:  # excess goes round until no source is above twice its size
        level = left / sum(weights[s] for s in free) if free else 0
        above = {s for s in free if level * weights[s] > 2 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= above
    target |= {s: level * weights[s] for s in free}
    for s, of in sources.items():
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in of)
        assert abs(sum(r["taken"] for r in of) - target[s]) <= max(r["size"] for r in of) / 2 + 1e-6
    return sorted((tuple(r) for r in rows), key=repr)


def test_mix_meets_targets_and_reruns_agree(documents):
    assert check_mix(documents) == check_mix(documents.repartition(7))


def test_one_source_with_most_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    check_mix(docs)


def test_odd_rows_in_the_mix(odd_documents, no_documents):
    check_mix(odd_documents)
    carried = mix_sources(odd_documents, carry=tuple(odd_documents.columns))
    assert carried.count() == odd_documents.count() and len(set(carried.columns)) == len(carried.columns)
    assert mix_sources(no_documents).count() == 0


def test_one_row_many_times_is_spread(spark):
    from pyspark.sql import functions as F

    from forecourt.llm.support import Work
    from forecourt.llm.fixity import index_records

    same = spark.range(0, 100_000, 1, 8).selectExpr("7L AS doc_id", "'the same text' AS text", "'en' AS lang", "'a' AS source", "13L AS n_chars")
    out = byte_shards(same)
    sizes = [r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 100_000
    assert out.groupBy("shard", "slot").count().filter("count > 1").isEmpty()
    work = Work(spark)
    records = index_records(work, spark.range(0, 20_000, 1, 8).selectExpr("7L AS page_id", "'u' AS url", "'x' AS html"))
    assert records.select("offset").distinct().count() == 20_000
    parts = spark.read.parquet(f"{work.root}/000").groupBy("part").count()
    assert parts.count() > 1
