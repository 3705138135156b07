"""Corpus preparation: documents in, packed training sequences out, in stages over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.llm import common as C
from washline.llm.decontaminate import clean
from washline.llm.jaccard import ngram_components, small
from washline.llm.packing import pack, vocabulary_path
from washline.llm.quality import quality_model
from washline.llm.repeats import remove_repeats

#: near duplicates: five words, similarity of 0.8 or more
WORDS, SIMILAR, OF = 5, 80, 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality_model(docs.select("doc_id", "text"), C.table(spark, sf_dir, "labels"))
    return model.transform(docs).where(F.col("predicted") == 1).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays.

    Texts without words belong to no group and stay. Rows are told apart by a number of
    their own: of rows with one id (or none) only those in a group with an earlier row go.
    """
    row = C.fresh_name(docs, "row_number")
    docs = C.numbered(docs, row)
    groups = C.store(ngram_components(docs.select(F.col(row).alias("doc_id"), "text"), WORDS, SIMILAR, OF), "pipeline-groups")
    gone = small(C.store(groups.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(row)), "pipeline-copies"))
    return docs.join(gone, row, "left_anti").drop(row)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that occur earlier are cut; documents that hold nothing else go."""
    cut = remove_repeats(docs)
    cut = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark passage go."""
    return clean(docs, C.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece, with its token ids and its place in a sequence."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_group),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The learned classifier is not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread by the next stage."""
    docs = C.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = C.store(docs, f"pipeline-{i}-{name}")
    return docs
