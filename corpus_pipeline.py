"""From documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of ``documents``. Rows that share an id count as one document and stay or go together; rows with a null id
are never taken for copies. Empty tables go through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, mixing, packing, phrases, quality
from larkspur.llm.scratch import Scratch
from larkspur.session import on_workers

#: Power that flattens the languages' token shares.
MIX_POWER = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model, least=0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    near = jaccard.near_duplicates(docs, n=5, num=80, den=100)
    return docs.join(near.filter("doc_id != component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that an earlier document has; documents left with no word go."""
    found = phrases.repeated_phrases(docs, with_text=True).filter("n_removed > 0 AND doc_id IS NOT NULL")
    changed = found.select("doc_id", F.col("kept_text").alias("_kept"), (F.col("n_removed") == F.col("n_words")).alias("_gone")).dropDuplicates(["doc_id"])
    left = docs.join(changed, "doc_id", "left").filter("_gone IS NULL OR NOT _gone")
    text = F.coalesce("_kept", "text")
    chars = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return left.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that the languages' token shares come near their flattened ones; every document stays.

    Rates are taken relative to those of the domain with the least of them, and none is under 1.
    """
    rates = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), public_tokenizers.path("byte_bpe_50k.json"), targets=MIX_POWER)
    means = rates.groupBy("domain").agg((F.sum(F.col("rate") * F.col("n_tokens")) / F.sum("n_tokens")).alias("m"))
    least = means.agg(F.min("m")).first()[0] or 1.0
    return mixing.materialise(docs, rates.select("doc_id", F.greatest(F.lit(1.0), F.col("rate") / least).alias("rate")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: A learned model, a transitive closure and an encoder are among the stages, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = on_workers(spark).read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as s:
        for _, stage in STAGES[:-1]:
            docs = s.write(stage(spark, docs, sf_dir))
        return s.keep(STAGES[-1][1](spark, docs, sf_dir))
