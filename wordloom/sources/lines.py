"""Formats of text sources, from lines to tables. ``readers`` adds the files around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_comma(lines: DataFrame) -> DataFrame:
    """``label int, words``: split at the first comma only; other columns stay."""
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.regexp_extract("line", r"^([^,]*),(?s)(.*)$", 1).cast("int").alias("label"), F.split(F.trim(F.regexp_extract("line", r"^([^,]*),(?s)(.*)$", 2)), r"\s+").alias("words"))


def raw_union(puns: DataFrame, negatives: DataFrame, proverbs: DataFrame) -> DataFrame:
    """``kind, doc, label``: puns without their first and last character; proverbs of over five tokens."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace("line", r"[^\w\s]", " ")), r"\s+"), lambda t: t != "")
    one = puns.select(F.lit("pun").alias("kind"), F.expr("substring(line, 2, length(line) - 2)").alias("doc"), F.lit(1).alias("label"))
    two = negatives.select(F.lit("neg").alias("kind"), F.col("line").alias("doc"), F.lit(-1).alias("label"))
    three = proverbs.where(F.size(tokens) > 5).select(F.lit("proverb").alias("kind"), F.col("line").alias("doc"), F.lit(-1).alias("label"))
    return one.unionByName(two).unionByName(three)


def hashtag_tsv(lines: DataFrame, drop_midnight: bool = False, hashtags: str = "keep") -> DataFrame:
    """``hashtag, tweet_id, body, label`` of ``file, line``; a line without three fields raises.

    hashtags: keep, drop, or words (underscores to spaces); dropping wins over words.
    """
    parts = F.split("line", "\t")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), "line")).cast("array<string>"))
    body = checked[1]
    if drop_midnight:
        body = F.regexp_replace(body, r"(?i)@midnight", "")
    if hashtags == "drop":
        body = F.regexp_replace(body, r"#\w+", "")
    elif hashtags == "words":
        body = F.regexp_replace(body, r"#(\w+)", "$1")
    return lines.select(F.regexp_replace("file", r"\.tsv$", "").alias("hashtag"), checked[0].alias("tweet_id"), F.trim(body).alias("body"), checked[2].cast("int").alias("label"))


def merge_later(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Keys of the later source replace those of the earlier."""
    return older.join(newer.select(key).distinct(), key, "left_anti").unionByName(newer)


def null_literal(rows: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    value = F.col(column)
    return rows.withColumn(column, F.when(value == "NULL", F.lit(default)).when(value == "", None).otherwise(value).cast("double"))


def mean_judgements(rows: DataFrame) -> DataFrame:
    """``strength``: the mean of space-separated scores over 100, by the pair ``a, b`` across all rows."""
    return rows.select("a", "b", F.explode_outer(F.split("scores", " ").cast("array<double>")).alias("s")).groupBy("a", "b").agg((F.avg("s") / 100).alias("strength"))


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins two sources line by line on ``file, line_no``."""
    return left.join(right, ["file", "line_no"])


def response_strengths(rows: DataFrame, columns: list[str], sentinels: tuple[str, ...], as_count: bool = False) -> DataFrame:
    """``cue, resp, strength``: responses up to the first sentinel (any case), counted over the cue's rows."""
    low = [s.lower() for s in sentinels]
    given = F.array(*columns)
    end = F.array_position(F.transform(given, lambda r: r.isNull() | F.lower(r).isin(*low)), True)
    taken = F.when(end > 0, F.slice(given, F.lit(1), (end - 1).cast("int"))).otherwise(given)
    total = rows.groupBy("cue").agg(F.count("*").alias("t"))
    counts = rows.select("cue", F.explode(taken).alias("resp")).groupBy("cue", "resp").agg(F.count("*").alias("n"))
    return counts.join(total, "cue").select("cue", "resp", (F.col("n") if as_count else F.col("n") / F.col("t")).alias("strength"))


def edge_tuples(rows: DataFrame, upper: bool) -> DataFrame:
    """``cue, resp, w`` of ``cue, resp, w, line``: upper-cased with the last of duplicate edges, or as they are."""
    if not upper:
        return rows.select("cue", "resp", "w")
    return rows.groupBy(F.upper("cue").alias("cue"), F.upper("resp").alias("resp")).agg(F.max_by("w", "line").alias("w"))


def subjectivity(lines: DataFrame) -> DataFrame:
    """``word, tag`` of ``key=value`` lines: strong or weak, and positive or negative."""
    m = F.str_to_map("line", F.lit(" "), F.lit("="))
    word = lines.select(m["word1"].alias("word"), F.explode(F.array(F.regexp_replace(m["type"], "subj$", ""), m["priorpolarity"])).alias("tag"))
    return word.where(F.col("tag").isin("strong", "weak", "positive", "negative")).distinct()


def wordnet_domains(lines: DataFrame) -> DataFrame:
    """``offset, synset, domains``: three fields, ``#`` in names read as a dot."""
    p = F.split(F.trim("line"), r"\s+", 3)
    return lines.select(p[0].alias("offset"), F.translate(p[1], "#", ".").alias("synset"), F.split(p[2], r"\s+").alias("domains"))


def concept_assertions(lines: DataFrame) -> DataFrame:
    """``rel, w1, w2`` of assertions whose two concepts are English."""
    p = F.split("line", "\t")
    rows = lines.select(F.split(p[1], "/")[2].alias("rel"), p[2].alias("a"), p[3].alias("b")).where(F.col("a").startswith("/c/en/") & F.col("b").startswith("/c/en/"))
    return rows.select("rel", F.split("a", "/")[3].alias("w1"), F.split("b", "/")[3].alias("w2"))


def frequency_sums(lines: DataFrame) -> DataFrame:
    """``ngram, n``: the sum of every other column from the second on; other columns stay."""
    p = F.split("line", "\t")
    freq = F.filter(p, lambda _, i: i % 2 == 1)
    n = F.aggregate(freq, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return lines.select(*(c for c in lines.columns if c != "line"), p[0].alias("ngram"), n.alias("n"))


def collection_scan(rows: DataFrame, least: dict, exists: list[str], unlike: dict) -> DataFrame:
    """Rows with lower bounds, present fields and excluded values; the predicates reach the scan."""
    tests: list[Column] = [F.col(k) >= v for k, v in least.items()] + [F.col(k).isNotNull() for k in exists] + [F.col(k) != v for k, v in unlike.items()]
    return rows.where(reduce(lambda a, b: a & b, tests))


def tagged_tweets(lines: DataFrame) -> DataFrame:
    """``tweet_id, tokens, tags, label`` of six tab fields, of which the last may be missing."""
    p = F.split("line", "\t")
    return lines.select(p[3].alias("tweet_id"), F.split(p[0], " ").alias("tokens"), F.split(p[1], " ").alias("tags"), F.try_element_at(p, F.lit(6)).cast("int").alias("label"))


def captions(lines: DataFrame) -> DataFrame:
    """The second field of every line but the first (``line_no`` from 0)."""
    return lines.where("line_no > 0").select("line_no", F.split("line", "\t")[1].alias("caption"))


def missing_floats(lines: DataFrame, names: list[str]) -> DataFrame:
    """Tab fields ``id``, then floats of which an empty one is missing, then text."""
    p = F.split("line", "\t")
    return lines.select(p[0].alias("id"), *(F.nullif(p[i], F.lit("")).cast("double").alias(n) for i, n in enumerate(names, 1)), p[len(names) + 1].alias("text"))


def pajek(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices ``id, name`` and arcs ``cue, resp, w`` of ``line_no, line``; sections start at a star."""
    head = F.when(F.col("line").startswith("*"), F.lower(F.regexp_extract("line", r"^\*(\w+)", 1)))
    marks = lines.where(F.col("line").startswith("*")).select(F.col("line_no").alias("from"), head.alias("section")).withColumn("until", F.lead("from").over(Window.orderBy("from")))  # a row per section
    body = lines.join(F.broadcast(marks), (F.col("line_no") > F.col("from")) & (F.col("until").isNull() | (F.col("line_no") < F.col("until"))))
    q = F.regexp_extract("line", r'^\s*(\d+)\s+"?([^"]*)"?', 2)
    v = body.where("section = 'vertices'").select(F.regexp_extract("line", r"^\s*(\d+)", 1).try_cast("int").alias("id"), F.trim(q).alias("name"))
    p = F.split(F.trim("line"), r"\s+")
    arcs = body.where("section IN ('arcs', 'edges')").select(p[0].try_cast("int").alias("s"), p[1].try_cast("int").alias("t"), F.try_element_at(p, F.lit(3)).try_cast("double").alias("w"))
    named = arcs.join(v.select(F.col("id").alias("s"), F.col("name").alias("cue")), "s").join(v.select(F.col("id").alias("t"), F.col("name").alias("resp")), "t")
    return v, named.select("cue", "resp", "w")


def concat_features(key: str, *parts: DataFrame) -> DataFrame:
    """Feature tables side by side; every key must be in all."""
    return reduce(lambda a, b: a.join(b, key), parts)
