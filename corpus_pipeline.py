"""A corpus pipeline over ``documents``: each stage calls one operator of the llm subpackage.

Each stage works on all rows that the one before kept, and its decisions take effect:
rejected documents and dropped lines are gone, one document of each near-duplicate
group is left, the mix repeats and leaves out documents by its targets, and the last
stage gives the token ids of what remains, decoded again as a check.

All stages but the last return the columns of their input, further ones included, whatever
their names; an empty table stays one. Very long texts are whole in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.llm import bpe, lines, mixing, quality, simhash_parts
from mediashoal.storage import fresh_path, materialize, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """With the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: without documents that the base rules or the perplexity bands reject. A null
    text has no words and goes; a null language is one of its own; copies of one text in
    one language stay or go together; a text at a limit stays."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: texts without the lines that a document of a larger id keeps; ``n_chars`` as
    it is then. Rows of one id are one document; those without an id keep all lines; a
    null text becomes an empty one."""
    return _measured(lines.dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: of each group of texts linked at a similarity of 0.8 or more in five-word
    shingles, the document with the least id; of rows that repeat it, one. A null text is
    like an empty one. Rows without an id stay if their group has no id, one for each text."""
    return simhash_parts.deduplicate(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: a row for each time that a document's words are taken whole, and one for a
    part; ``n_chars`` as it is then. A null source is one source; a null text has no words
    and is not taken; rows with one id, source and size share what is taken."""
    return _measured(mixing.apply_mix(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: ``(doc_id, n_tokens, tokens, decoded_sha256)`` per row, repeats and null ids as
    they are; a null text has no tokens."""
    both = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]

#: No SQL can state the perplexities and merges of the stages; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        with scope(spark):  # what a stage wrote on its way goes
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
