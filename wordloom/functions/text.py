"""Text expressions: every function maps columns to a column and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part-of-speech prefixes of the treebank tag set and their one-letter classes (fixed values).
TAG_CLASSES = {"J": "a", "V": "v", "N": "n", "R": "r"}


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def white_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def filter_tokens(words: Column, stopwords: Column) -> Column:
    """Lower case, stop words out, then punctuation stripped, then empty tokens out, in that order."""
    kept = F.filter(F.transform(words, F.lower), lambda t: ~F.array_contains(stopwords, t))
    return F.filter(F.transform(kept, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")), lambda t: t != "")


def strip_tags(tagged: Column) -> Column:
    """From ``array<struct<token, pos>>`` to the tokens."""
    return F.transform(tagged, lambda t: t["token"])


def sanitise(text: Column) -> Column:
    """Lower case; mentions, links and hashtags by class; long ellipses shortened; ends trimmed."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"https?://\S+", "URL")
    t = F.regexp_replace(t, r"@\w+", "TOUSER")
    t = F.regexp_replace(t, r"#(\w+)", "HASH_$1")
    return F.trim(F.regexp_replace(t, r"\.{2,}", "..."))


def replace_by_tag(words: Column, tags: Column) -> Column:
    """Tokens tagged U, @ or # give way to their class."""
    one = lambda p: F.when(p["g"] == "U", "HYPER_LINK").when(p["g"] == "@", "AT_USERNAME").when(p["g"] == "#", "HASH_HASHTAG").otherwise(p["t"])
    return F.transform(F.arrays_zip(words.alias("t"), tags.alias("g")), one)


def is_game_tweet(text: Column) -> Column:
    """At most one mention, which must begin with @midnight, and at most one hashtag."""
    mentions, tags = F.regexp_extract_all(text, F.lit(r"@\w+"), F.lit(0)), F.regexp_count(text, F.lit(r"#\w+"))
    return (F.size(mentions) <= 1) & (tags <= 1) & ((F.size(mentions) == 0) | F.element_at(mentions, 1).rlike("(?i)^@midnight"))


def strip_mentions(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[@#]\w+", ""))


def setup_words(name: Column, stopwords: Column) -> Column:
    """Words of a file name without stop words, ``in``, ``words`` and single digits."""
    words = F.split(F.lower(F.regexp_replace(name, r"\.[A-Za-z]+$", "")), "_")
    return F.filter(words, lambda w: ~F.array_contains(stopwords, w) & ~w.isin("in", "words", "") & ~w.rlike("^[0-9]$"))


def treebank_to_wordnet(tag: Column) -> Column:
    out = F.lit("n")
    for prefix, kind in TAG_CLASSES.items():
        out = F.when(F.upper(F.substring(tag, 1, 1)) == prefix, kind).otherwise(out)
    return out


def noun_phrases(tags: Column) -> Column:
    """Chunks of adjectives followed by nouns, from a space-joined string of tags."""
    return F.regexp_extract_all(tags, F.lit(r"((?:JJ[RS]? )*(?:NN(?:S|PS?)? ?)+)"), F.lit(1))


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clean_key(text: Column) -> Column:
    """Without a byte order mark and all but letters, digits and spaces: a key that punctuation does not change."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"[^A-Za-z0-9 ]", "")))


def n_grams(words: Column, n: int) -> Column:
    number = F.size(words) - n + 1
    grams = F.transform(F.sequence(F.lit(1), number), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(number >= 1, grams).otherwise(F.array().cast("array<string>"))


def counted(words: Column) -> Column:
    """``array<struct<w, n>>``: each word of an array once, with how often it occurs, in order of the words."""

    def runs(s: Column) -> Column:
        # an array of one binds a value, which a lambda would otherwise work out again for each element
        first = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return F.transform(F.array(first), lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n"))))[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def bigrams(words: Column) -> Column:
    """Each word and the next, with a space between."""
    rest = lambda a: F.greatest(F.size(a) - 1, F.lit(0))
    return F.transform(F.array(words), lambda a: F.zip_with(F.slice(a, F.lit(1), rest(a)), F.slice(a, F.lit(2), rest(a)), lambda x, y: F.concat(x, F.lit(" "), y)))[0]


def sentence_words(docs: DataFrame) -> DataFrame:
    """``doc, sent, i, w`` of ``doc, text``: lower-case words by sentence."""
    sent = docs.select("doc", F.posexplode(F.split(F.lower("text"), "[.!?]+")).alias("sent", "s"))
    return sent.select("doc", "sent", F.posexplode(tokens(F.col("s"))).alias("i", "w"))


def tagged(words: DataFrame, tags: DataFrame) -> DataFrame:
    """Words with the tag of a table ``w, tag``, which a tagger makes for all distinct words at once; others have none."""
    return words.join(tags, "w", "left")


def regrouped(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``doc, tokens array<struct<w, tag>>`` in order of sentence and place; empty for documents without words."""
    found = words.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent", "i", "w", "tag"))).alias("t"))
    none = F.array().cast("array<struct<w:string,tag:string>>")
    return docs.select("doc").join(found, "doc", "left").select("doc", F.coalesce(F.transform("t", lambda x: F.struct(x["w"].alias("w"), x["tag"].alias("tag"))), none).alias("tokens"))
