"""The corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of documents. ``n_chars`` is kept equal to the text's length where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import lines, near_duplicates, packing, substrings, toxicity
from wordloom.llm.queries import vocabulary_file
from wordloom.llm.store import Store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more; labels come from the table of labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("toxic_score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, except in the largest id."""
    return _documents(lines.dedup_lines(docs, min_docs=3, min_chars=20))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near-duplicates; documents without an id all stay."""
    others = near_duplicates.near_duplicates(docs.select("doc_id", "text")).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of 200-byte strings that start twice; what a cut leaves of a character goes with it."""
    cut = substrings.dedup_substrings(docs, length=200, as_text=True)
    return _documents(cut.withColumn("text", F.col("kept")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_substrings),
    ("packing", pack_sequences),
]

#: Scores, similarities and suffix arrays are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.put(docs, name)
    return docs
