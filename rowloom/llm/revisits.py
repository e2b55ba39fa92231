"""WARC revisits: not-modified records are resolved to the latest earlier full response of the same URL.

As-of join by canonical URL: of each revisit, the full response (status 200) with the largest capture time before its own; of
several at that time, the one with the largest record id. Its validators are then compared: entity tags by weak comparison where both have
one, else the dates of last modification where both have one. If they agree, the stored headers are updated with those of the
revisit, except the ones that describe the stored body.

A URL may hold any share of the records, also within one second: records are first put together to one row for each (URL, capture time),
which are cut into slices of about equal rows by range partitions. The latest response inside a slice is found by a window over it, and one
row per slice carries the latest response of earlier slices. No window spans a URL's records. Only DataFrame operations are used, and
bodies are not moved.

A revisit without URL or capture time has no earlier response and is put aside first; a response without them is none. Repeated revisits each keep
their row; repeated responses are one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.frames import join_counted
from rowloom.session import write_stage

# Headers of a 304 that do not replace stored ones, and query parameters that only track.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)(=|$)"
# Escaped characters that mean the same as the characters themselves.
UNRESERVED = {"%7[Ee]": "~", "%2[Dd]": "-", "%2[Ee]": ".", "%5[Ff]": "_"}


def canonical_url(url: str) -> Column:
    """Host and path without scheme, credentials, www, default port, fragment and trailing slash; tracking parameters dropped.

    The other query parameters are ordered by name; those of one name keep their order, which may matter to the page.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(url)), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    for escaped, plain in UNRESERVED.items():
        bare = F.regexp_replace(bare, escaped, plain)
    place = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(place, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    named = F.transform(kept, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("name"), i.alias("i"), p.alias("p")))
    kept = F.transform(F.sort_array(named), lambda x: x["p"])
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _entries(headers: Column) -> Column:
    """Headers as a sorted list, which can be compared."""
    return F.sort_array(F.map_entries(headers))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, captured_at, response_id, response_at, outcome, headers) of every revisit.

    `records`: record_id, url, captured_at (bigint), kind ('response', 'revisit'), status, etag, last_modified, headers (map, lower-case names).
    Outcome: resolved, validators_differ, no_validator or no_response; only resolved revisits have headers.
    """
    keyed = records.select("record_id", canonical_url("url").alias("url_key"), "captured_at", "kind", "status", "etag", "last_modified", "headers")
    keyed = write_stage(keyed.filter("kind = 'revisit' OR (kind = 'response' AND status = 200 AND captured_at IS NOT NULL AND url_key IS NOT NULL)"), "records")
    complete = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    response = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "etag", "last_modified", _entries(F.col("headers")).alias("headers")))
    asked = F.count(F.when(F.col("kind") == "revisit", 1)).alias("asked")
    times = keyed.filter(complete).groupBy("url_key", "captured_at").agg(F.max(response).alias("here"), asked)
    cut = write_stage(times.repartitionByRange("url_key", "captured_at").withColumn("slice", F.spark_partition_id()), "times")
    earlier = Window.partitionBy("url_key", "slice").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("inside", F.max("here").over(earlier)).filter("asked > 0").drop("here")
    carried = cut.groupBy("url_key", "slice").agg(F.max("here").alias("latest")).withColumn(
        "carried", F.max("latest").over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    latest = inside.join(carried.select("url_key", "slice", "carried"), ["url_key", "slice"]).select(
        "url_key", "captured_at", "asked", F.coalesce("inside", "carried").alias("stored"))
    revisits = keyed.filter("kind = 'revisit'").drop("kind", "status")
    found = join_counted(revisits.filter(complete), write_stage(latest, "latest"), ["url_key", "captured_at"], "asked").drop("asked")
    found = found.unionByName(revisits.filter(~complete), allowMissingColumns=True)
    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    same = F.when(F.col("etag").isNotNull() & F.col("stored.etag").isNotNull(), tag("etag") == tag("stored.etag")).when(
        F.col("last_modified").isNotNull() & F.col("stored.last_modified").isNotNull(), F.col("last_modified") == F.col("stored.last_modified"))
    found = found.withColumn("outcome", F.when(F.col("stored").isNull(), "no_response").when(same, "resolved").when(same.isNull(), "no_validator").otherwise("validators_differ"))
    new = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    old = F.map_filter(F.map_from_entries("stored.headers"), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
                                                                  F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return found.select("record_id", "url_key", "captured_at", F.col("stored.record_id").alias("response_id"), F.col("stored.captured_at").alias("response_at"),
                        "outcome", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of the pages table: a first capture of every page and a later conditional request.

    Some first captures are partial (206), some revisits come from a changed page (another tag) or carry dates only. Times follow
    page_id, so later captures of one URL lie between a capture and its revisit.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    page = F.col("page_id")
    date = F.concat(F.lit("day "), (page % 9).cast("string"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    response = pages.select(
        (page * 2).alias("record_id"), "url", (page * 10).alias("captured_at"), F.lit("response").alias("kind"), F.when(page % 13 == 0, 206).otherwise(200).alias("status"),
        F.when(page % 11 != 0, F.when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)).alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), (page * 10).cast("string")).alias("headers"))
    later = page * 10 + 1 + (page % 5) * 1000
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), "url", later.alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(page % 11 != 0, F.when(page % 7 == 0, F.concat(F.lit('"new-'), F.expr("substring(md5(coalesce(html, '')), 1, 8)"), F.lit('"'))).otherwise(tag)).alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("expires"), (later + 60).cast("string")).alias("headers"))
    return response.unionByName(revisit)
