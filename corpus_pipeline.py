"""Corpus preparation: quality rules, exact deduplication, near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it reads all that its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from sievework.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from sievework.llm.shared import discard, read, written


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules or their language's perplexity band go."""
    return quality.keep_documents(docs)


def exact_copies(spark, docs, sf_dir):
    """Of texts equal but for white space one stays."""
    return exact_dedup.keep_documents(docs)


def near_copies(spark, docs, sf_dir):
    """Of each class of documents linked by their five-word shingles, at a similarity of 0.8 or more, one stays."""
    return jaccard_join.keep_documents(docs, window=5, up=80, down=100)


def mixed(spark, docs, sf_dir):
    """The documents in training order, repeated or left out as the mix takes them."""
    return mixing.training_order(docs)


def tokens(spark, docs, sf_dir):
    """Each document's token ids (little-endian unsigned 32-bit integers) and what they decode to."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixed),
    ("BPE", tokens),
]
#: The perplexity model and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = read(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
        # What a stage has read is not needed once it is done.
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
