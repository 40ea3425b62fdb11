"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them back.

Every stage: null text is empty text and stays null; a null doc_id stays null and such rows are never dropped as copies; very
long texts are worked on whole; of near copies, and of repeated rows, the smallest doc_id stays, of rows that repeat an id and its text
one; an empty table gives an empty table; extra columns are kept, whatever their names, by all stages but packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import decontaminate, jaccard_join, packing, pii, toxicity
from fieldbook.llm.common import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies stays."""
    return jaccard_join.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate.reject(docs, read(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data is replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents' token sequences, packed."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_private),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, SimHashes and the packing search have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, f"pipeline-{name}")
    return docs
