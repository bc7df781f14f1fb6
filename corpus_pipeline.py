"""Corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame; ``run`` writes it as Parquet in the shared scratch folder and reads it
for the next stage.  All stages but the last return the columns of documents.
Null doc_ids pass every filter that their text passes and are linked with
nothing; rows that repeat a doc_id stay or go together in the near-duplicate
stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.anchor_pii import redact_documents
from custlens.llm.common import read_table
from custlens.llm.decision_list import fit_rules, judge
from custlens.llm.hilbert_pack import pack
from custlens.llm.lsh_forest import near_duplicates
from custlens.llm.weak_toxicity import fit, score
from custlens.session import materialise_table


def _rest(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct that no operator's columns
    can clash with."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[c if c in ("doc_id", "text") else f"rest.{c}" for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls toxic go.

    Whole texts are scored.  A null or empty text has no vote for toxic and stays;
    copies are scored each and alike; a null doc_id is scored but never learned
    from.  Columns named like the operator's (score, predicted, held_out) stay as
    they are; an empty table, or labels of one kind, leave the fixed lists alone."""
    return _back(score(_rest(docs), fit(docs, read_table(spark, sf_dir, "labels"))).filter("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go.

    Whole texts are counted.  A null or empty text has no words, fails the base rules
    and goes; copies and rows of a null doc_id are judged each; the first rule in
    order that holds decides.  Columns named like a statistic stay as they are; an
    empty table, or labels of one kind, give no rules and leave the base."""
    rules = fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return _back(judge(_rest(docs), rules, ["doc_id", "text", "rest"]).filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest doc_id."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    Whole texts are searched; every row stays.  A null text stays null, an empty one
    empty; copies are redacted each and alike; a run of overlapping spans becomes the
    kind of its first.  n_chars follows the new text; other columns stay as they are."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their ids.

    Whole texts are cut freely, so a long one spans sequences.  A null or empty text
    is its end id alone; copies are packed each; equal Hilbert keys go by doc_id (null
    first), rows of one doc_id in the order they were read.  Of the input only doc_id and text are read; an empty table gives no
    pieces."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: No stage is SQL: see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
