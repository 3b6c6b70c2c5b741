"""Not-modified revisits of web archives: an as-of join to the latest earlier full response.

Records are dealt by range of canonical URL, date and id, so a URL with any share of all captures fills
as many ranges as it needs. A window runs inside each range; what a range must know of those before it is
the last full response of its URLs there, a row for each range and URL. Payloads take no part until each
revisit knows its response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

#: Headers that describe the body or the connection; a not-modified answer must not change them (fixed values).
FORBIDDEN = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, ``www.`` and default port; path without a last slash; sorted query, no fragment.

    Query fields of campaigns (``utm_``) go.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def lower_names(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only, the last in order of name stays."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names)), e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """Resolves revisits to full responses.

    records: ``id long, url string, date long, kind string`` (``response`` or ``revisit``), ``status int, headers
    map<string,string>, payload string``. A full response has status 200 and a payload. Returns a row per revisit:
    ``id, url, canonical, refers_to, resolved, reason, headers, payload``.

    The latest full response of the canonical URL strictly before the revisit (by date, then id) decides; its
    ETag must equal the revisit's, weak marks aside, or, where the revisit has none, its Last-Modified. The
    stored headers are then updated by the revisit's, but for those that describe body or connection. Reasons
    else: ``no earlier response``, ``validator mismatch``, ``no validator``; such rows keep their own headers and no
    payload. Null URLs and dates match nothing; rows without an id or kind are left out; rows repeated under one
    id are one record (the smallest); other columns are ignored; an empty table gives no rows.
    """
    store = Store(records.sparkSession, "warc")
    kept = records.select("id", "url", "date", "kind", "status", lower_names(F.col("headers")).alias("headers"), F.col("payload").cast("string").alias("payload")).where("id IS NOT NULL AND kind IN ('response', 'revisit')")
    first = Window.partitionBy("id").orderBy("kind", "date", "url", "status", F.xxhash64("payload"))
    kept = kept.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumn("canonical", canonical_url(F.col("url")))
    kept = store.put(kept, "records")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()
    slim = kept.where("canonical IS NOT NULL AND date IS NOT NULL").select("canonical", "date", "id", F.when(full, F.struct("date", "id", header(F.col("headers"), "etag").alias("etag"), header(F.col("headers"), "last-modified").alias("modified"))).alias("full"), (F.col("kind") == "revisit").alias("asks"))
    parts = max(1, -(-slim.count() // range_rows))
    dealt = store.put(slim.repartitionByRange(parts, "canonical", "date", "id").withColumn("part", F.spark_partition_id()), "dealt")
    inside = F.last("full", ignorenulls=True).over(Window.partitionBy("part", "canonical").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, -1))
    ends = dealt.groupBy("canonical", "part").agg(F.max("full").alias("full"))
    carry = ends.select("canonical", "part", F.last("full", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry")).where("carry IS NOT NULL")
    asked = dealt.withColumn("inside", inside).where("asks").join(carry.hint("merge"), ["canonical", "part"], "left").select("id", F.coalesce("inside", "carry").alias("found"))
    revisits = kept.where("kind = 'revisit'").select("id", "url", "canonical", F.col("headers").alias("own")).join(store.put(asked, "asked").hint("merge"), "id", "left")

    bare = lambda e: F.regexp_replace(e, r"^\s*[Ww]/", "")
    etag, modified = header(F.col("own"), "etag"), header(F.col("own"), "last-modified")
    same = F.when(etag.isNotNull(), F.coalesce(bare(etag) == bare(F.col("found.etag")), F.lit(False))).otherwise(F.coalesce(modified == F.col("found.modified"), F.lit(False)))
    reason = F.when(F.col("found").isNull(), "no earlier response").when(etag.isNull() & modified.isNull(), "no validator").when(~same, "validator mismatch")
    judged = store.put(revisits.select("id", "url", "canonical", "own", reason.alias("reason"), F.when(reason.isNull(), F.col("found.id")).alias("refers_to")), "judged")
    stored = kept.where(full).select(F.col("id").alias("refers_to"), F.col("headers").alias("stored"), "payload")
    # rows that refer to nothing would all meet in one partition of the join
    both = judged.where("refers_to IS NOT NULL").join(stored.hint("merge"), "refers_to", "left")
    update = F.map_filter("own", lambda k, v: ~k.isin(*FORBIDDEN))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    done = both.select("id", "url", "canonical", "refers_to", F.lit(True).alias("resolved"), "reason", merged.alias("headers"), "payload")
    rest = judged.where("refers_to IS NULL").select("id", "url", "canonical", "refers_to", F.lit(False).alias("resolved"), "reason", F.col("own").alias("headers"), F.lit(None).cast("string").alias("payload"))
    return done.unionByName(rest)
