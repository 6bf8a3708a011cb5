"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and
returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``. Rows without doc_id, which no decision
could name, go in the first stage; rows alike in doc_id stay or go together; NULL text is
no language's and goes there too. Empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlure.llm import jaccard, langid, linededup, packing, suffixdedup
from flowlure.llm.tables import read_table
from flowlure.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; rejected ones go, their labels stay as they are."""
    named = docs.where(F.col("doc_id").isNotNull())
    return langid.predict(named, langid.fit(named), ("text", "lang", "source", "n_chars")).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; a document left without a word goes."""
    found = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_length(found.where(~emptied))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    groups = jaccard.near_duplicates(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long strings that the corpus holds twice; a text that was nothing else goes."""
    found = suffixdedup.apply_spans(docs, suffixdedup.repeated_spans(docs), ("lang", "source"), as_text=True)
    whole = found.where((F.col("n_bytes") == 0) | (F.col("kept") != ""))
    return _with_length(whole.withColumn("text", F.col("kept")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("repeats", repeats), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    root = ensure_checkpoint_dir(spark).rstrip("/")
    for name, stage in STAGES:
        path = f"{root}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
#: SQL can express neither the trained model nor the packing.
ORACLE_SQL: dict[str, str] = {}
