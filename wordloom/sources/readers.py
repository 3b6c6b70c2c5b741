"""File readers and sinks around the line formats of ``lines``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import numbered
from . import lines as L


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line_no, line``: whole files split at line ends, so numbers hold within each file."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "utf-8")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line``; splittable, without numbers."""
    return spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("line"))


def puns(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered_lines(spark, path).where("line_no > 0").select(F.col("line_no").alias("doc"), "line")
    return L.first_comma(rows)


def raw_puns(spark: SparkSession, positive: str, negative: str, proverbs: str) -> DataFrame:
    return L.raw_union(*(text_lines(spark, p) for p in (positive, negative, proverbs)))


#: What the Windows code page 1252 has in place of the control characters of Latin 1.
LATIN = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = bytes(range(0x80, 0xA0)).decode("windows-1252", "replace")


def one_liners(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """``doc, label``: +1 and -1, files in the Windows code page 1252."""

    def side(path: str, label: int) -> DataFrame:
        text = F.translate(F.decode("content", "iso-8859-1"), LATIN, WINDOWS)
        rows = spark.read.format("binaryFile").load(path).select(F.explode(F.split(text, r"\r?\n")).alias("doc"))
        return rows.where("doc <> ''").withColumn("label", F.lit(label))

    return side(positive, 1).unionByName(side(negative, -1))


def hashtag_files(spark: SparkSession, folders: Sequence[str], **options) -> DataFrame:
    """All ``*.tsv`` of the folders; a hashtag in a later folder replaces an earlier one."""
    merged = None
    for f in folders:
        rows = L.hashtag_tsv(text_lines(spark, f"{f}/*.tsv"), **options)
        merged = rows if merged is None else L.merge_later(merged, rows, "hashtag")
    return merged


def rated_tweets(spark: SparkSession, path: str, train: bool = True, header: bool = True) -> DataFrame:
    """``id, text, is_humor, rating``; a test file has id and text only."""
    columns = ["id", "text"] + (["is_humor", "n_ratings", "n1", "n2", "n3", "n4", "n5", "rating"] if train else [])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"')
    if not train:
        return rows.select("id", "text", F.lit(None).cast("int").alias("is_humor"), F.lit(None).cast("double").alias("rating"))
    return L.null_literal(rows.withColumn("is_humor", F.col("is_humor").cast("int")), "rating").select("id", "text", "is_humor", "rating")


def evocation(spark: SparkSession, groups: Sequence[tuple[str, str]]) -> DataFrame:
    """``a, b, strength`` from pairs of files, one with synset pairs and one with judgements, line by line."""
    every = None
    for pairs, scores in groups:
        left = numbered_lines(spark, pairs).select("line_no", F.split("line", r",\s*|\s+").alias("p"))
        right = numbered_lines(spark, scores).select("line_no", F.col("line").alias("scores"))
        rows = left.join(right, "line_no").select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "scores")
        every = rows if every is None else every.unionByName(rows)
    return L.mean_judgements(every)


def responses(spark: SparkSession, path: str, columns: Sequence[str] = ("R1", "R2", "R3"), sentinels: Sequence[str] = ("No more responses", "NA"), as_count: bool = False) -> DataFrame:
    """Association strengths of a response table; columns other than R1 to R3 and files without ``cue`` are refused."""
    if not set(columns) <= {"R1", "R2", "R3"}:
        raise ValueError(f"responses are R1, R2 and R3, not {list(columns)}")
    rows = spark.read.csv(path, header=True)
    if "cue" not in rows.columns:
        raise ValueError("the file has no column cue")
    return L.response_strengths(rows, list(columns), tuple(sentinels), as_count)


def strengths(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    a, b, *_, s = rows.columns
    return rows.where(F.col(a).isNotNull()).select(F.col(a).alias("cue"), F.col(b).alias("resp"), F.col(s).cast("double").alias("strength"))


def association_xml(spark: SparkSession, path: str, share_of: str, count: str) -> DataFrame:
    """``cue, resp, strength``: a response's count over its stimulus' total (or of two response fields)."""
    number = T.StringType()
    response = T.StructType([T.StructField("_word", T.StringType()), T.StructField(f"_{count}", number), T.StructField(f"_{share_of}", number)])
    schema = T.StructType([T.StructField("_word", T.StringType()), T.StructField(f"_{share_of}", number), T.StructField("response", T.ArrayType(response))])
    rows = spark.read.format("xml").option("rowTag", "stimulus").schema(schema).load(path).select(F.col("_word").alias("cue"), F.col(f"_{share_of}").alias("total"), F.explode("response").alias("r"))
    total = F.coalesce("total", F.col(f"r._{share_of}")).cast("double")
    return rows.select("cue", F.col("r._word").alias("resp"), (F.col(f"r._{count}").cast("double") / total).alias("strength"))


def pajek_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return L.pajek(numbered_lines(spark, path))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``w, v`` of a text file of vectors, with or without a first line of sizes."""
    p = F.split(F.trim("line"), r"\s+")
    return text_lines(spark, path).where(F.size(p) > 2).select(p[0].alias("w"), F.slice(p, F.lit(2), F.size(p) - 1).cast("array<double>").alias("v"))


def gaussian_vectors(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """``w, mu, sigma`` of a table ``vec_id, mu, sigma`` and a vocabulary file of ids, words and counts.

    Rows without a word, and words without a row, are left out.
    """
    p = F.split("line", "\t")
    words = text_lines(spark, vocabulary).where(F.size(p) >= 2).select(p[0].cast("long").alias("vec_id"), p[1].alias("w"))
    return spark.read.parquet(path).join(words, "vec_id").select("w", "mu", "sigma")


@dataclass
class Dictionary:
    """Document frequencies ``w, df`` and the number of documents they come from."""

    frequencies: DataFrame
    docs: int

    def weigh(self, counts: DataFrame) -> DataFrame:
        """``doc, w, x`` of counts ``doc, w, tf``; words that the dictionary lacks are left out."""
        return counts.join(self.frequencies, "w").select("doc", "w", (F.col("tf") * F.log2(F.lit(self.docs) / F.col("df"))).alias("x"))


def save_dictionary(counts: DataFrame, path: str) -> None:
    """The dictionary of ``doc, w``, as two tables."""
    pairs = counts.select("doc", "w").distinct()
    pairs.groupBy("w").agg(F.count("*").alias("df")).write.parquet(f"{path}/frequencies")
    pairs.agg(F.countDistinct("doc").alias("docs")).write.parquet(f"{path}/size")


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(spark.read.parquet(f"{path}/frequencies"), spark.read.parquet(f"{path}/size").first().docs)


def save_topics(weights: DataFrame, path: str) -> None:
    """Weights ``w, topic, n`` of a topic model."""
    weights.select("w", "topic", "n").write.parquet(path)


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """``w, topic, x``: each word's share of a saved topic."""
    t = spark.read.parquet(path)
    return t.join(t.groupBy("topic").agg(F.sum("n").alias("total")), "topic").select("w", "topic", (F.col("n") / F.col("total")).alias("x"))


def ngram_counts(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    rows = text_lines(spark, path).select("line")
    if raw:
        return L.frequency_sums(rows)
    p = F.split("line", "\t")
    return rows.select(p[0].alias("ngram"), p[1].cast("long").alias("n"))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("line", "\t")
    return text_lines(spark, path).select(F.split(p[0], " ").alias("tokens"), F.split(p[1], " ").alias("tags"), F.split(p[2], " ").cast("array<double>").alias("probs"), p[3].alias("original"))


def side_cars(tweets: DataFrame, key: str, *features: DataFrame) -> DataFrame:
    """Tweets with feature tables by key; a tweet that one of them lacks raises when read."""
    out = tweets
    for i, f in enumerate(features):
        names = [c for c in f.columns if c != key]
        out = out.join(f.withColumn(f"_has{i}", F.lit(True)), key, "left")
        checked = F.when(F.col(f"_has{i}"), F.col(names[0])).otherwise(F.raise_error(F.concat(F.lit("no features for "), F.col(key).cast("string"))))
        out = out.withColumn(names[0], checked.cast(f.schema[names[0]].dataType)).drop(f"_has{i}")
    return out


def recoded(spark: SparkSession, path: str, encoding: str, **options) -> DataFrame:
    return spark.read.csv(path, encoding=encoding, **options)


def write_predictions(rows: DataFrame, path: str, by: str = "hashtag") -> None:
    rows.write.partitionBy(by).option("sep", "\t").csv(path)


def write_features(rows: DataFrame, key: str, path: str) -> None:
    """One table per feature, so a reader opens only what it asks for."""
    for c in rows.columns:
        if c != key:
            rows.select(key, c).write.parquet(f"{path}/{c}")


def read_features(spark: SparkSession, key: str, path: str, names: Sequence[str]) -> DataFrame:
    return L.concat_features(key, *(spark.read.parquet(f"{path}/{n}") for n in names))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_derived(rows: DataFrame, **columns) -> DataFrame:
    """Derived columns beside the old ones; a name that exists is refused, so nothing is overwritten."""
    taken = set(columns) & set(rows.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    return rows.withColumns(columns)


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an interrupted run has not finished."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def pajek_text(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``part, line``: a Pajek file's lines, vertices numbered from 1 in order of name."""
    v = numbered(vertices.select("name").distinct(), "name", name="id")
    head = v.agg(F.concat(F.lit("*Vertices "), F.count("*").cast("string")).alias("line")).select(F.lit(0).alias("part"), "line")
    names = v.select(F.lit(1).alias("part"), F.concat(F.col("id").cast("string"), F.lit(' "'), "name", F.lit('"')).alias("line"))
    mark = v.sparkSession.createDataFrame([(2, "*Arcs")], "part int, line string")
    ends = arcs.join(v.select(F.col("name").alias("cue"), F.col("id").alias("s")), "cue").join(v.select(F.col("name").alias("resp"), F.col("id").alias("t")), "resp")
    return head.unionByName(names).unionByName(mark).unionByName(ends.select(F.lit(3).alias("part"), F.concat_ws(" ", F.col("s").cast("string"), F.col("t").cast("string"), F.col("w").cast("string")).alias("line")))
