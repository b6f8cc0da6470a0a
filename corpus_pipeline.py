"""From raw documents to shards: each stage works on all that the one before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.decontaminate import clean_documents
from forecourt.llm.mixing import mix_sources
from forecourt.llm.near_dups import near_duplicates
from forecourt.llm.quality import judge_quality
from forecourt.llm.sharding import byte_shards
from forecourt.llm.support import Work

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_before: list[Work] = []


def _work(spark: SparkSession) -> Work:
    """Tables of one stage. Those of the stage before go, whose result has been written when the next one begins."""
    while _before:
        _before.pop().clear()
    _before.append(Work(spark))
    return _before[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = judge_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS, work=_work(spark))
    return judged.filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates(docs, carry=COLUMNS, work=_work(spark)).filter("stays").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    _work(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix_sources(docs, carry=COLUMNS, work=_work(spark))
    repeated = mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return byte_shards(docs, carry=COLUMNS, work=_work(spark))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The quality, near-duplicate and leak stages learn from the data, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again before the next one."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.store(stage(spark, docs, sf_dir))
        work.keep(docs)
    return docs
