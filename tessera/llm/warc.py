"""Operator 4, WARC: resolving not-modified revisits.

A revisit record says that a page had not changed and carries validators and a few headers, but no body. It is
joined, by canonical URL and as of its time, to the latest earlier full response. If its validators agree with that
response, headers that a 304 may update replace the stored ones, and the body is the response's.

As-of join without a hot task: the time axis is cut at quantiles; each (URL, slice) is one group, and what earlier
slices hand on is one row for each (URL, slice), found by a pre-aggregation. So the records of one URL spread over as
many tasks as there are slices, and records of one time are one row before they meet. Only ids travel; headers are
joined at the end, in a join that adaptive execution splits where very many revisits resolve to one response.

Defined results: a null URL or time resolves to nothing (no_response); of responses at the same time the largest id
counts, and a response at the revisit's own time is not earlier; rows with equal record_id each keep a row and are
resolved by their own URL and time; of responses with one id the earliest is stored (then the smallest digest and
headers); a revisit without validators is resolved by an equal payload digest, without that it is no_validator; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 never updates.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding")
#: Query parameters that don't change a page.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and final slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"(?i)^https?://(www\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})="))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, updated by those that a 304 may update. Names are lower case."""
    new = F.map_filter(update, lambda k, _: ~k.isin(*KEPT))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _tag(x: Column) -> Column:
    return F.regexp_replace(x, "^W/", "")


def resolve(records: DataFrame, slices: int = 64) -> DataFrame:
    """(record_id, canonical_url, response_id, outcome, headers, payload_digest) of each revisit.

    records: record_id long, url string, time long, kind ('response' or 'revisit'), headers map<string,string> with
    lower-case names, payload_digest string. outcome: resolved, mismatch, no_validator or no_response.
    """
    url = canonical_url(F.col("url"))
    log = records.select("record_id", "time", "kind", "headers", "payload_digest", url.alias("u"))
    cuts = sorted(set(log.agg(F.percentile_approx("time", [k / slices for k in range(1, slices)], 1000).alias("c")).first()["c"] or []))
    slim = log.select("record_id", "time", "kind", "u", F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("time"))).alias("slice")) if cuts else log.select("record_id", "time", "kind", "u", F.lit(0).alias("slice"))
    full = F.when((F.col("kind") == "response") & F.col("time").isNotNull(), F.struct("time", "record_id"))
    groups = slim.groupBy("u", "slice").agg(F.max(full).alias("last"), F.max(F.col("kind") == "revisit").alias("asks"))
    handed = groups.select("u", "slice", "asks", F.max("last").over(Window.partitionBy("u").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("handed")).filter("asks").select("u", "slice", "handed")
    earlier = Window.partitionBy("u", "slice").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    times = slim.filter(F.col("u").isNotNull() & F.col("time").isNotNull()).groupBy("u", "slice", "time").agg(F.max(full).alias("at"), F.max(F.col("kind") == "revisit").alias("asks"))
    own = times.withColumn("own", F.max("at").over(earlier)).filter("asks")
    pointed = own.join(handed, ["u", "slice"], "left").select("u", "time", F.coalesce("own", "handed")["record_id"].alias("response_id"))
    revisits = log.filter(F.col("kind") == "revisit").join(pointed, ["u", "time"], "left")
    order = F.struct("time", "payload_digest", F.to_json("headers").alias("h"))
    first = log.filter(F.col("kind") == "response").groupBy(F.col("record_id").alias("response_id")).agg(F.min_by(F.struct("headers", "payload_digest"), order).alias("r"))
    stored = first.select("response_id", F.col("r.headers").alias("stored"), F.col("r.payload_digest").alias("stored_digest"))
    # a revisit without a response has a join key of its own, so they don't meet in one task
    own_key = F.struct(F.col("response_id").isNull().alias("none"), F.coalesce("response_id", "record_id").alias("id"))
    its_key = F.struct(F.lit(False).alias("none"), F.col("response_id").alias("id"))
    both = revisits.withColumn("key", own_key).join(stored.select(its_key.alias("key"), "stored", "stored_digest"), "key", "left")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agrees = (
        F.when(etag.isNotNull(), _tag(etag) == _tag(F.col("stored")["etag"]))
        .when(modified.isNotNull(), modified == F.col("stored")["last-modified"])
        .when(F.col("payload_digest").isNotNull(), F.col("payload_digest") == F.col("stored_digest"))
    )
    outcome = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(etag.isNull() & modified.isNull() & F.col("payload_digest").isNull(), "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    out = both.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return out.select("record_id", F.col("u").alias("canonical_url"), "response_id", "outcome", F.when(done, merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), F.when(done, F.col("stored_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A log of captures of pages: each page's response, a later revisit, and a revisit before the response.

    One page in five has changed by its later revisit, one in seven sends a date instead of a tag, one in eleven nothing.
    """
    digest, day = F.md5(F.col("html").cast("binary")), F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    p = pages.select("page_id", "url", F.octet_length("html").cast("string").alias("size"), digest.alias("digest"), tag.alias("tag"), day.alias("day"))

    def record(nth: int, time: Column, kind: str, headers: Column, payload: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + nth).alias("record_id"), "url", time.alias("time"), F.lit(kind).alias("kind"), headers.alias("headers"), payload.alias("payload_digest"))

    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("tag"), F.lit("last-modified"), F.col("day"), F.lit("cache-control"), F.lit("no-cache"))
    small = (F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"))
    by_date = F.create_map(*small, F.lit("last-modified"), F.col("day"))
    by_tag = F.create_map(*small, F.lit("etag"), F.when(F.col("page_id") % 5 == 4, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))))
    none = F.lit(None).cast("string")
    records = F.array(
        record(0, F.col("page_id") * 10, "response", stored, F.col("digest")),
        record(1, F.col("page_id") * 10 + 1_000_003, "revisit", F.when(F.col("page_id") % 11 == 5, F.create_map(*small)).when(F.col("page_id") % 7 == 3, by_date).otherwise(by_tag), none),
        record(2, F.col("page_id") * 10 - 5, "revisit", F.create_map(*small), F.col("digest")),
    )
    return p.select(F.explode(records).alias("r")).select("r.*")


def digest(resolved: DataFrame) -> DataFrame:
    """Flat columns of what resolve() returns."""
    h = F.col("headers")
    return resolved.select("record_id", "canonical_url", "response_id", "outcome", h["content-type"].alias("content_type"), h["content-length"].alias("content_length"), h["etag"].alias("etag"), h["cache-control"].alias("cache_control"), "payload_digest")


SQL = r"""
WITH bare AS (SELECT page_id, md5(html) AS digest, octet_length(encode(html)) AS size, 'day ' || (page_id % 28) AS day,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www\.)?', '', 'i') AS b FROM pages),
parts AS (SELECT page_id, digest, size, day, '"' || digest || '"' AS tag, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, list_sort([x FOR x IN string_split(regexp_extract(b, '\?(.*)$', 1), '&')
    IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)=')]) AS q FROM bare),
p AS (SELECT page_id, digest, size, day, tag, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM parts),
revisits AS (
    SELECT page_id * 4 + 1 AS record_id, u, page_id * 10 + 1000003 AS t, CASE WHEN page_id % 7 <> 3 AND page_id % 11 <> 5 THEN CASE WHEN page_id % 5 = 4 THEN '"changed"' ELSE 'W/' || tag END END AS etag,
        CASE WHEN page_id % 7 = 3 AND page_id % 11 <> 5 THEN day END AS modified, NULL AS digest FROM p
    UNION ALL SELECT page_id * 4 + 2, u, page_id * 10 - 5, NULL, NULL, digest FROM p),
ranked AS (SELECT r.*, s.page_id AS sid, s.tag AS stag, s.day AS sday, s.digest AS sdigest, s.size AS ssize,
    row_number() OVER (PARTITION BY r.record_id ORDER BY s.page_id DESC NULLS LAST) AS k FROM revisits r LEFT JOIN p s ON s.u = r.u AND s.page_id * 10 < r.t),
judged AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN etag IS NULL AND modified IS NULL AND digest IS NULL THEN 'no_validator' WHEN coalesce(CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = stag
    WHEN modified IS NOT NULL THEN modified = sday ELSE digest = sdigest END, false) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM ranked WHERE k = 1)
SELECT record_id, u AS canonical_url, sid * 4 AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
    CASE WHEN outcome = 'resolved' THEN CAST(ssize AS VARCHAR) ELSE '0' END AS content_length, CASE WHEN outcome = 'resolved' THEN coalesce(etag, stag) ELSE etag END AS etag,
    'max-age=60' AS cache_control, CASE WHEN outcome = 'resolved' THEN sdigest ELSE digest END AS payload_digest FROM judged
"""
