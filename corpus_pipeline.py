"""Corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, encoding.

Each stage reads what its predecessor kept, written as Parquet to the shared folder. All but the last return the columns
of ``documents``, extra columns included. Null texts stay until line dedup, which makes them empty; rows without doc_id
pass stages that reject by doc_id; repeated rows of a doc_id stay or go together; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, lines, minhash, pieces, toxicity
from gridloom.llm.catalog import MODEL
from gridloom.llm.common import join_small, stage, table


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among the rejected."""
    return join_small(docs, stage(rejected.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; held-out labels are not learnt from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return _without(docs, toxicity.score(docs, model).where("score >= 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; ``n_chars`` follows the text."""
    kept = lines.apply(docs, lines.bitmaps(docs, min_docs=10))
    columns = {c: F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns}
    return kept.select(*[v.alias(c) for c, v in columns.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    found = minhash.near_duplicates(docs, percent=80)
    return _without(docs, found.where("NOT kept AND doc_id IS NOT NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding returned the text."""
    return pieces.encode(docs, pieces.read_model(MODEL))


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]
#: The toxicity model and the Viterbi search are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
