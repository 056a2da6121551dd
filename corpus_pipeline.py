"""From raw documents to token ids, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridelta.llm import bpe as _bpe
from veridelta.llm import exact_dedup as _exact
from veridelta.llm import jaccard as _jaccard
from veridelta.llm import language as _language
from veridelta.llm import mixing as _mixing
from veridelta.llm.common import documents, table
from veridelta.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not recognise go; it is trained on the table's own labels. Null, empty and letterless texts are not recognised, so they go; repeated rows go or stay together; an empty table stays empty. Other columns, whatever their names, are carried along."""
    out, (language, score, accepted) = _language.identify(docs, _language.train(docs))
    return out.where(out[accepted]).drop(language, score, accepted)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the lowest id stays (null last). Null texts are no copies of each other; the empty text is a text like any other, and so is a very long one. Other columns, whatever their names, are carried along."""
    return _exact.exact_dedup(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar n-gram sets connect, the one of the lowest id stays (null last). Texts that are null or have no words are near nothing, and stay. Other columns, whatever their names, are carried along."""
    return _jaccard.dedup_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as source and language weights ask for, some not at all. Null sources and languages are values of their own; texts without words keep the rate of their cell, or 1. Other columns, whatever their names, are carried along."""
    return _mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to the text again. A null text has null ids, the empty text none; a very long one is encoded in parts that join."""
    out, (ids, n, exact) = _bpe.encode_column(docs, VOCABULARY)
    return out.select("doc_id", "lang", "source", out[n].alias("n_tokens"), out[ids].alias("ids"), out[exact].alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Language ID and entropy balancing have no SQL; tests hold every stage against brute force on what its predecessor left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs
