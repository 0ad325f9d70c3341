"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents whose score reaches the threshold go.
2. minhash: one document of each group of near-duplicates (five-word shingles, 0.8) stays.
3. secrets: every secret found in a text is replaced by a mark; no document goes.
4. mixing: sources are brought to their target shares; a document comes once for each full
   pass over it, and once with the words of its extra blocks.
5. packing: token pieces and their place in sequences of 1024.

Defined results: null and empty texts are scored like any other, link with nothing and hold no
secret; mixing takes no words of them, so they go there. Repeated rows are near-duplicates and one
stays; rows that share a doc_id and have unlike texts all stay, as do rows with a null doc_id.
Columns beside doc_id, text, source and n_chars pass through whatever their names. Ties go to the
least doc_id. An empty table, or one without labels, runs through; without documents the result
is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import minhash, mixing, packing, secrets, toxicity
from factloom.llm.common import Shelf, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, block_words=32)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("minhash", minhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL expresses a trained classifier or a tokenizer; tests compare the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one returns."""
    shelf = Shelf(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        before, docs = docs, shelf.put(out)
        shelf.drop(before)
    return docs
