"""From raw documents to token ids: five operators of ``dialoglab.llm`` as one pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents; each works on every row that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoglab.llm import bpe, exact_dedup, mixing, ngram_join, quality
from dialoglab.llm.common import documents, stage_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of texts that share four fifths of their 5-word shingles stays."""
    return ngram_join.one_of_each(docs, n=5, num=4, den=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated or left out as their source's target says; rows come in shuffled order."""
    return mixing.mixture(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: each document's ids and a digest of what they decode to."""
    import public_tokenizers as vocab

    return bpe.digest(bpe.encode_documents(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN))


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("byte-level BPE", token_ids),
]

#: SQL cannot express the sketches, the similarity join, the mix or the merges; tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"stage-{i}")
    return docs
