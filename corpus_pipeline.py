"""The training-data pipeline over ``documents``: rules, classifier, near-duplicates, mixing, tokens.

Each stage takes the documents that its predecessor kept and is one operator of ``quillstream.llm``; all but the last
return the columns of ``documents``, and the last adds to them, with the place in the mix. Nulls, empty and very long texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash
from quillstream.llm.support import materialise, read_table


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and the calibrated verdict; rejected documents go."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kernel classifier, learnt from the labels that its own split allows; documents that score below 0.7 go.

    The labels of documents that an earlier stage rejected still teach the classifier what low quality is.
    """
    everything = read_table(spark, sf_dir, "documents")
    stats = materialise(quality_classifier.statistics(everything), "statistics")
    model = quality_classifier.fit(stats, read_table(spark, sf_dir, "labels"), learn=~quality_classifier.held_out())
    return quality_classifier.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix: the files in order of name, and each file's rows, interleave the sources."""
    return mixing.interleave(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their position in the mix (from 0), their ids, and whether decoding gives the text again.

    The position is read from what the mix wrote: files in order of name, and each file's rows.
    """
    return sentencepiece_codec.encode(mixing.stored_order(docs, "position"), round_trip_col="round_trip")


STAGES = [
    ("quality rules", apply_rules),
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("SentencePiece encoding", tokenise),
]

#: Fitted models, hashes and tokenizers have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
