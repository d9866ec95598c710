"""The corpus pipeline: quality rules, quality classifier, near-dedup, suffix dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it back from Parquet. All but the last
return the columns of documents.

* quality_rules: documents that the base rules or the trees reject go. The trees are grown on the labelled rows of the
  documents table, a bounded sample, so they don't depend on what earlier stages kept.
* quality_classifier: documents whose compression score is under CLASSIFIER_THRESHOLD go; the dictionaries come from a
  bounded sample of the labelled rows of the documents table.
* near_dedup: of each class of near-duplicates the document with the smallest id stays.
* suffix_dedup: bytes of 50-byte strings that start in a smaller document are cut out of the texts; all documents stay,
  some with an empty text; n_chars follows the text.
* packing: the tokens of all texts packed into sequences of 4096.

The filters judge every row by itself, whatever its id; repeated ids share a verdict of near_dedup, so a repeated row stays
with its first, and rows without an id stay. Null texts count as empty and go with the rules; very long texts are taken whole;
further columns are left behind. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidefit.llm import compression_quality, near_dedup, packing, quality_rules, suffix_dedup
from slidefit.llm.common import drop_since, drop_table, write_table, written_so_far

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A score under it rejects a document; lower than one half, so that only clear cases go.
CLASSIFIER_THRESHOLD = 0.25


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    trees = quality_rules.fit_on(_source(spark, sf_dir, "documents"), _source(spark, sf_dir, "labels"))
    return quality_rules.keep(docs.select(*COLUMNS), trees)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = compression_quality.fit(_source(spark, sf_dir, "documents"), _source(spark, sf_dir, "labels"))
    return compression_quality.keep(docs.select(*COLUMNS), model, CLASSIFIER_THRESHOLD)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    gone = near_dedup.classes(docs).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat a smaller one."""
    cut = suffix_dedup.remove_repeats(docs, carry=["lang", "source"], with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trees, the dictionaries or the packing plan; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read back."""
    docs, before = _source(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = written_so_far()
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        drop_since(spark, mark, path)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
