"""A training corpus in five stages: language ID, near-dedup, repeated strings, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written as Parquet and read again as the next one's
docs; a stage may be called only after the one before it has been written.  The stages but the last return the columns of
`documents`; mixing returns a document once for each pass that takes any of it, in training order.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thermolith.llm import bpe, common, langid, minhash, mixing, suffix_dedup

#: Rejected are texts without a letter, those in which no language stands out, and those unlike the language found
#: (`langid.Likelihood`, whose measure does not depend on the number of languages).
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a learnt language is found.

    Null, empty and letterless texts go.  Without any labelled document nothing is learnt and all go.  Texts are read whole,
    however long; rows alike in text get the same verdict; ids, sources and labels decide nothing.  An empty table gives
    no rows.  All columns are kept, whatever their names."""
    return langid.accepted(docs, least=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that are alike in four fifths of their five-word shingles the one of least id.

    Null and wordless texts and rows without an id stay.  Rows of one id stay or go by their own texts; rows alike in id
    and words stay or go together.  An empty table gives no rows.  All columns are kept, whatever their names."""
    return minhash.deduplicate(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that start earlier too; a text may become empty.

    A null text becomes empty.  Null ids come last; rows alike in id are ordered by text, rows alike in both are one
    document.  An empty table gives no rows.  All columns but `text` are kept as they are."""
    return suffix_dedup.deduplicate(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix that takes any of a document, in training order.

    Texts without words, null ones among them, are never taken.  A null source is a source of its own, the last.  Rows
    alike in id are ordered by text.  An empty table gives no rows.  All columns are kept, whatever their names."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix.

    A null text is encoded as an empty one.  Rows alike give rows alike.  An empty table gives no rows.  Other columns,
    whatever their names, are not read."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("mixing_sources", mixing_sources), ("tokens", tokens)]

#: The stages are beyond SQL; tests hold each against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what a stage has read goes when it has been written
            common.delete(spark, before)
        before = path
    return docs
