"""Stand-ins for the resources that operators take as tables, each in Spark and in SQL.

Short texts are the whole ``benchmark`` table, so pairs of words run over whole texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import pairs as P
from ..operators.lineage import shared_folder

#: Small lexicons over words that the tables hold (fixed values).
STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "as", "with", "was", "be", "by", "at", "or", "an", "are", "from", "this")
LEXICON = (("the", "weak"), ("of", "weak"), ("and", "strong"), ("that", "strong"), ("with", "positive"), ("for", "positive"), ("this", "negative"), ("from", "negative"), ("is", "positive"), ("is", "strong"))
ANTONYMS = (("the", "of"), ("and", "or"), ("to", "from"), ("in", "at"))
SENSES = (("the", "s1", "sexuality"), ("of", "s2", "food"), ("of", "s3", "sexuality"), ("and", "s4", "sport"), ("that", "s5", "sexuality"), ("that", "s6", "law"), ("that", "s7", "law"), ("that", "s8", "law"), ("with", "s9", "sexuality"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def sql_rows(values, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(str(tuple(v)) for v in values)}) AS t({names}))"


#: A stand-in for a tagger, by the endings of words.
TAG_SQL = "CASE WHEN w LIKE '%ed' THEN 'VBD' WHEN w LIKE '%ly' THEN 'RB' WHEN w LIKE '%ble' THEN 'JJ' ELSE 'NN' END"


def tag(w: Column) -> Column:
    return F.when(w.endswith("ed"), "VBD").when(w.endswith("ly"), "RB").when(w.endswith("ble"), "JJ").otherwise("NN")


def tok(spark: SparkSession, sf_dir: str, name: str = "benchmark", key: str = "item_id") -> DataFrame:
    return P.explode_tokens(table(spark, sf_dir, name), key)


def counts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """``doc, w, n`` of whole texts."""
    return P.word_counts(table(spark, sf_dir, name), key)


def tok_sql(name: str = "benchmark", key: str = "item_id", alias: str = "tok") -> str:
    return f"{alias} AS (SELECT {key} AS doc, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM {name}))"


def docs(spark: SparkSession, sf_dir: str, name: str = "benchmark", key: str = "item_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("doc"))


PAIRS_SQL = "pairs AS (SELECT a.doc, a.w AS w1, b.w AS w2, count(*) AS times FROM tok a JOIN tok b ON a.doc = b.doc AND a.pos < b.pos GROUP BY 1, 2, 3)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``w, v``: a word has the vector that its hash names; a tenth of words have none."""
    number = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    words = tok(spark, sf_dir).select("w").distinct().withColumn("h", number).where("h % 10 <> 0").crossJoin(F.broadcast(e.agg(F.count("*").alias("size"))))
    return words.withColumn("vec_id", F.col("h") % F.col("size")).join(e, "vec_id").select("w", "v")


VECTORS_SQL = "vec AS (SELECT w, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT w, h % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT w, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) AS h FROM tok) WHERE h % 10 <> 0) JOIN embeddings USING (vec_id))"


def edges(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """``cue, resp, w``: adjacent words of conversations that occur together ``least`` times."""
    t = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc"), F.posexplode(P.tokens(F.col("text"))).alias("pos", "w"))
    nxt = t.withColumn("resp", F.lead("w").over(Window.partitionBy("doc").orderBy("pos"))).where("resp IS NOT NULL")
    return nxt.groupBy(F.col("w").alias("cue"), "resp").agg(F.count("*").alias("w")).where(F.col("w") >= least)


EDGES_SQL = "edges AS (SELECT cue, resp, count(*) AS w FROM (SELECT w AS cue, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS resp FROM (SELECT conv_id, turn, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations))) WHERE resp IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)"
STRENGTH_SQL = EDGES_SQL + ", strength AS (SELECT cue, resp, w / sum(w) OVER (PARTITION BY cue) AS p FROM edges)"


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``child, parent``: nations under regions under a root."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionByName(r.select(F.col("r_name").alias("child"), F.lit("ROOT").alias("parent")))


TAXONOMY_SQL = "tax AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'ROOT' FROM region)"
CLOSURE_SQL = TAXONOMY_SQL + ", clo AS (WITH RECURSIVE up(node, anc, d) AS (SELECT DISTINCT child, child, 0 FROM (SELECT child FROM tax UNION SELECT parent FROM tax) UNION ALL SELECT node, parent, d + 1 FROM up JOIN tax ON anc = child) SELECT node, anc, min(d) AS d FROM up GROUP BY 1, 2)"


def game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_type, id, score, tier``: events as rated entries; the best is of tier 2, the next nine of 1."""
    r = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    tier = F.when(r == 1, 2).when(r <= 10, 1).otherwise(0)
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("value").alias("score"), tier.alias("tier"))


GAME_SQL = "game AS (SELECT user_id, event_type, event_id AS id, value AS score, CASE WHEN r = 1 THEN 2 WHEN r <= 10 THEN 1 ELSE 0 END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events))"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/fixtures-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, encoding: str | None = None) -> str:
    """One text file of a column ``line`` (in order of ``n``, if there is one) under just this name; returns the name."""
    spark = lines.sparkSession
    lines = lines.orderBy("n").select("line") if "n" in lines.columns else lines
    part = f"{path}-parts"
    if encoding:
        lines.coalesce(1).write.option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(part)
    else:
        lines.coalesce(1).write.text(part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(conf)
    fs.mkdirs(name(path).getParent())
    for f in fs.listStatus(name(part)):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), name(path))
    fs.delete(name(part), True)
    return path
