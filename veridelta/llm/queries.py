"""The registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, bpe, exact_dedup, jaccard, language, mixing, neighbours, sharding, suffix, toxicity
from .common import documents

#: Shards that the corpus is cut into.
SHARDS = 64
#: Rows whose id is divisible by this are the queries of a search.
QUERIES_EVERY = 50
#: Vocabulary file; it has to be at this path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.passages(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("n_words")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (ids, n, exact) = bpe.encode_column(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY)
    return out.select("doc_id", out[n].alias("n_tokens"), out[ids].alias("ids"), out[exact].alias("exact"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(documents(spark, sf_dir))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_shards(documents(spark, sf_dir), VOCABULARY)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out, (language_, score, accepted) = language.identify(docs.select("doc_id", "lang", "text"), language.train(docs))
    return out.select("doc_id", "lang", out[language_].alias("language"), out[score].alias("score"), out[accepted].alias("accepted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % QUERIES_EVERY == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARDS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (tokens, rate, copies), _ = mixing.rates(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", out[tokens].alias("tokens"), out[rate].alias("rate"), out[copies].alias("copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_byte_bpe, op4_suffix_dedup, op5_token_shards, op6_exact_dedup, op7_language_id, op8_nearest_neighbours, op9_sharding, op10_mixing)}

SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9''\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, list_sort(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS g FROM w WHERE len(w) > 0),
        d AS MATERIALIZED (SELECT doc_id, g, row_number() OVER () AS rid FROM s),
        t AS (SELECT rid, len(g) AS n, unnest(g) AS t FROM d),
        p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.t = b.t AND a.rid <> b.rid GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM p WHERE c / (na + nb - c) >= 0.5),
        r(rid, o) AS (SELECT rid, rid FROM d UNION SELECT e.b, r.o FROM r JOIN e ON r.rid = e.a),
        l AS (SELECT r.rid, min(d.doc_id) AS class_id FROM r JOIN d ON d.rid = r.o GROUP BY 1)
        SELECT d.doc_id, l.class_id, coalesce(k.n, 0) AS links FROM d JOIN l USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM e GROUP BY 1) k USING (rid)""",
    "op6_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of FROM documents WHERE text IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1""",
}
