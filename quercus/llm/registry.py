"""Queries of this subpackage with their SQL, by name."""

from __future__ import annotations

import public_tokenizers

from quercus.llm import bpe, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, topk, url_filter
from quercus.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op1_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
             FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
       SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query("op2_sharding")
def op2(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_chunks", "removed_chunks", "removed_bytes")


@query("op4_line_dedup", line_dedup.SQL)
def op4(spark, sf_dir):
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BPE)


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op8_url_filter", url_filter.SQL)
def op8(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


@query("op9_simhash")
def op9(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_bpe")
def op10(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), BPE)
