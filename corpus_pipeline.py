"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination,
mixing to source weights, token files.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a DataFrame; ``run`` writes that as Parquet in the
shared folder and reads it back as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import documents, materialise, word_count
from gridspark.llm.decontaminate import find_contamination
from gridspark.llm.mixing import copies, mix
from gridspark.llm.near_dedup import near_duplicates
from gridspark.llm.token_files import token_table
from gridspark.llm.toxicity import THRESHOLD, classify, corpus_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic: those whose
    score is below 0.3, the operator's ``predicted``. A null text is scored as an
    empty one; repeated rows stay or go alike."""
    scored = classify(docs, corpus_model(spark, docs, sf_dir))
    return scored.where(F.col("score") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays, the first by (doc_id,
    digest of the text); a null doc_id comes last. Rows without words are linked
    with nothing and stay. Rows that share a doc_id are judged one by one; of rows
    that share doc_id and text one stays."""
    found = near_duplicates(docs)
    row = F.xxhash64("text")
    gone = found.where(~F.col("stays")).select(F.col("doc_id").alias("_k"), F.col("digest").alias("_d")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_k")) & (row == F.col("_d"))
    kept = docs.join(gone, same, "left_anti")
    again = found.where(F.col("stays") & F.col("vertex").isNotNull()).groupBy(F.col("doc_id").alias("_k"), F.col("digest").alias("_d")).count().where("count > 1").select("_k", "_d")
    again = materialise(again, "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in a benchmark window."""
    found = find_contamination(docs, documents(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: their words taken, in whole
    documents to the nearest number, so from never to twice."""
    mixed = mix(docs.withColumn("_words", word_count(F.col("text"))), size="_words")
    times = F.sequence(F.lit(1), copies(F.col("_words"), F.col("taken")))
    mixed = mixed.where(copies(F.col("_words"), F.col("taken")) > 0)
    return mixed.withColumn("_copy", F.explode(times)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what is read back of each."""
    return token_table(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
