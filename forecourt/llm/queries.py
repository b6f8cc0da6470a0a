"""The registered queries of the corpus operators, one for each, and the SQL that checks them."""

from forecourt.llm import decontaminate, dialogue_repair, fill_middle, fixity, languages, mixing, near_dups, quality, sharding, surrogates, toxicity, url_filter, vector_search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


@_query()
def op2_filter_urls(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


@_query(vector_search.ORACLE_SQL)
def op3_nearest_vectors(spark, sf_dir):
    return vector_search.nearest_vectors(_table(spark, sf_dir, "embeddings"))


@_query(mixing.ORACLE_SQL)
def op4_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@_query()
def op5_replace_entities(spark, sf_dir):
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"))


@_query()
def op6_judge_quality(spark, sf_dir):
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(fixity.ORACLE_SQL)
def op7_audit_fixity(spark, sf_dir):
    return fixity.audit_damaged_replica(_table(spark, sf_dir, "pages"))


@_query()
def op8_score_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op9_byte_shards(spark, sf_dir):
    return sharding.byte_shards(_table(spark, sf_dir, "documents"))


@_query()
def op10_find_leaks(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query(fill_middle.ORACLE_SQL)
def op11_fill_in_middle(spark, sf_dir):
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


@_query()
def op12_identify_languages(spark, sf_dir):
    return languages.identify_held_out(_table(spark, sf_dir, "documents"))


@_query()
def op13_repair_conversations(spark, sf_dir):
    return dialogue_repair.repaired_digests(_table(spark, sf_dir, "conversations"))
