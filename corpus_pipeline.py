"""A training corpus from ``documents``: quality, lines, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

Defined results, for every stage: an empty table gives an empty result; null and
empty texts fail the quality rules; all columns of the input, whatever they are
called (two underscores at the start are kept for the stages), are those of the
output but for the last stage; rows are told apart by
id and text, so repeated ids with other texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import line_dedup, mixing, near_dedup, packing, quality
from quayside.llm.common import forget, named, new_folder, tokenizer_path, written_so_far

#: Words that a document has at least.  Short prose is no junk by itself: lower than the operator's own limit, so that clean short documents stay.
MIN_WORDS = 5
#: Passes over the most repeated source, where the least repeated one is passed once.
MAX_REPEATS = 1.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or base rules reject go; rows are judged alone, so repeated ones stay or go together."""
    out = quality.judged(docs, quality.labels_in(spark, sf_dir), docs.columns, MIN_WORDS)
    return out.where(F.col("__quality.kept")).drop("__quality")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the largest id; rows with a null id keep theirs; n_chars follows the text."""
    out = line_dedup.replace_text(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id; rows without words or id all stay."""
    return near_dedup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix wants it, at least once; a null source is one of its own, rows of one id stand equally often."""
    wanted = mixing.mix(docs, budget_share=None, max_repeats=MAX_REPEATS).select(F.col("doc_id").alias("__mix_id"), "copies")
    times = wanted.groupBy("__mix_id").agg(F.max("copies").alias("__mix_copies"))
    out = docs.join(times, F.col("doc_id") == F.col("__mix_id"), "left")
    copies = F.coalesce(F.greatest(F.col("__mix_copies"), F.lit(1)), F.lit(1)).cast("int")
    return out.select(*[named(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias("__mix_copy")).drop("__mix_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths in buckets, none across documents; a document without text is one separator."""
    return packing.pack_power_of_two(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", shared_lines),
    ("near dedup", near_copies),
    ("source mixing", mixed_sources),
    ("packing", packed),
]

#: Tokenisation and compression have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path, mark = new_folder(spark, f"pipeline-{name.replace(' ', '-')}"), written_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        forget(spark, mark)  # what the stage has written on its way
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
