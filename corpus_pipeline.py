"""From raw documents to token ids in five stages, each an operator of the ``llm`` subpackage.

Quality rules, line dedup, SimHash near-dedup, mixing to target weights, byte-level BPE. Every stage works on all
that its predecessor kept; each result is written as Parquet to the shared folder and read again. What a stage wrote
beside its result is removed when that is there.

Defined cases: a null or empty text fails the quality rules; a null source is a source and a host of its own; a null
doc_id comes last where documents are put in order and keeps its row; rows repeated in full are one document from line
dedup on, and of them one stays; of ties the smallest doc_id stays, then the smallest text hash; very long texts are
taken whole; an empty table gives an empty result; further columns go along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvid.llm import bpe, lines, mixing, quality, simhash
from corvid.llm.common import cleared, documents, scratch, small_batches

#: Words of a line that goes as a later copy even if no line beside it is repeated.
LONG_LINE = 50
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes, roughly, of what a worker of the last stage remembers: the executor's heap has grown in the stages before it.
REMEMBERED = 64 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the host's limit go from the others."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of long lines go, and documents that consist of them."""
    return lines.dedup(docs, single=LONG_LINE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: equal word sequences, or five-word shingles of a similarity of 0.8 or more."""
    return simhash.keep_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in order of training."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each use of a document; ids_sha256 and decoded_sha256 are digests of the ids and of what they decode to."""
    raw = bpe.vocabulary_file(public_tokenizers.path(VOCABULARY))
    found = bpe.digests(docs, raw, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), remembered=REMEMBERED)
    with small_batches(spark):  # holds for what is planned here, so the digests are written here
        return scratch(found, "encoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can't express the SimHash and BPE stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    with cleared() as settled:
        for name, stage in STAGES:
            docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
