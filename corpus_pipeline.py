"""A training corpus from documents: quality, exact and near duplicates, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, exact_dedup, jaccard, packing, quality, simhash
from assay.llm.shared import cut, small_side

QUALITY = 0.7
SHINGLE = 5


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that it stays the row's; and its column, of a name that docs lack."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality score 0.7 or more; the classifier learns from labels of docs itself."""
    voters = quality.fit_apart(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.column(docs, voters) >= QUALITY)


def _without(keyed: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """keyed but those rows whose number is in dropped, as `row`."""
    return keyed.join(small_side(dropped.select(F.col("row").alias(name))), name, "left_anti").drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts one row, of largest doc_id."""
    keyed, name = _keyed(docs)
    return _without(keyed, name, exact_dedup.mark_duplicates(keyed, row_col=name).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id.

    Two texts are near if operator 5 puts them into one SimHash group (5-word shingles, 4 bits) and they share
    half of their shingles or more, or if they share 0.8 or more: of such pairs SimHash at 4 bits reaches few, so
    bands of MinHash values propose them. Each pair is held against the exact shingles.
    """
    keyed, name = _keyed(docs)
    groups = simhash.near_duplicates(keyed, shingle=SHINGLE, id_col=name)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _without(keyed, name, keyed.select(F.col(name).alias("row")).join(jaccard.kept(keyed, name, groups, SHINGLE), "row", "left_anti"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    keyed, name = _keyed(docs)
    marked = decontaminate.overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name)
    return _without(keyed, name, marked.where("contaminated").select(F.col("doc_id").alias("row")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_benchmark), ("pack", pack)]

#: Neither SimHash, the classifier nor tokenization can be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
