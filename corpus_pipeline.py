"""A training corpus from ``documents``: language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns
is written as Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``; the last returns a row for each piece of a packed sequence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import jaccard, language, packing, personal
from pageloom.llm.common import cut, ensure_checkpoint_dir, table

#: Language models, a tagger and bin packing can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of a learned language; rejected rows and rows without letters go.

    Columns of any names are kept as they are.
    """
    model = language.train(language.training_rows(docs.where(~language.held_out())))
    names = ["text" if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)]
    kept = language.identify(docs.toDF(*names), model).where("not rejected").select(*names)
    return kept.toDF(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the group's smallest doc_id.

    Near duplicates share 0.8 of their five-word shingles (``jaccard``), or are linked by such.
    A row is told from others by its doc_id and text, so rows of one doc_id with other texts are
    judged by their own groups. Of a group's rows that share the smallest doc_id, the one with the
    least hash of text stays; a row without doc_id stays only if its group has no other.
    """
    key = F.struct(F.col("low").isNull().alias("none"), "low", "mark")
    first = jaccard.groups(docs).groupBy("root").agg(F.min(key).alias("key"))
    # equal keys without nulls, so that rows are shuffled once to be joined and told from their copies
    keys = ["_id", "_none", "_mark"]
    first = first.select(F.coalesce("key.low", F.lit(0)).alias("_id"), F.col("key.none").alias("_none"), F.col("key.mark").alias("_mark"))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_mark": jaccard.mark()})
    return keyed.join(first, keys).dropDuplicates(keys).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in angle brackets; n_chars, where there is one, counted anew."""
    clean = personal.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 2048 tokens, with its sequence and its place there."""
    return packing.packed(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each returns is written to the shared folder and read again.

    The result is written too, and the stages' folder goes.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    result = cut(STAGES[-1][1](spark, docs, sf_dir))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result
