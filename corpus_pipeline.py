"""A corpus pipeline: filter toxic documents, drop near-duplicates and benchmark leaks, mix sources, shard.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run`
writes every stage to the shared folder and rereads it, so a lost executor costs one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontam import drop_contaminated
from tidewater.llm.minhash import one_of_each
from tidewater.llm.mixing import Mix
from tidewater.llm.shared import saved, scratch
from tidewater.llm.sharding import assign_shards
from tidewater.llm.toxicity import drop_toxic


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel model doesn't reject. Null and empty texts stay; repeated rows fare alike."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_document_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (0.8 over five-word shingles), that with the least id.

    Texts without words are in no group and stay. Null ids come last; of rows that share id
    and text one stays, chosen by its other columns.
    """
    return one_of_each(docs, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage within the edit limit of a benchmark item. Null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: whole, in part, or a second time; `n_chars` is counted anew.

    Documents without words aren't taken. A null source is a source of its own.
    """
    names = docs.columns
    mixed = Mix(docs, carry=True).texts().toDF(*[f"c{k}" for k in range(len(names))], "copy")  # by position: any names will do
    n_chars = F.length(f"c{names.index('text')}").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[(n_chars if name == "n_chars" else F.col(f"c{k}")).alias(name) for k, name in enumerate(names)])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 40, their slot in it and their size. Copies of a document share its shard.

    Columns of the input named like these three, in any case, give way to them.
    """
    made = ["shard", "slot", "size"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return assign_shards(docs, carry=True).select(*kept, *made)


STAGES = [
    ("toxicity", clean_language),
    ("near_duplicates", one_document_each),
    ("decontamination", no_benchmark),
    ("mixing", mixture),
    ("sharding", sharded),
]
#: Fitted models, LSH and pseudorandom draws: not a query SQL can state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):  # what a stage wrote on its way goes once its rows are written
            docs = saved(stage(spark, docs, sf_dir), keep=True)
