"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit record holds no body: it says that a url was unchanged since an earlier
capture.  It resolves to the latest full response of its canonical url that is
strictly earlier, if the validators agree: entity tags decide where both records
have one, otherwise ``last-modified`` where both have it, otherwise the payload digests;
with nothing to compare it is ``unverified`` and stays unresolved.  The headers
that result are the response's, with those of the revisit laid over it that a
not-modified answer may change.

The as-of join is in two levels: rows meet in (url, span of time), and each span
hands its last response on through one row per span, so a url that holds a
third of all rows is spread over up to SPANS tasks.

Defined results: a null url has the canonical form '' and is a url like others; a null time is
earlier than all, and never an earlier response; responses of the same url and
time are taken by the larger record id; revisits at the time of a response do not
see it; null headers are empty; repeated rows are resolved alike; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spans of time that the rows of one url are dealt into.
SPANS = 512
#: Headers that a 304 answer may update in the stored response.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme-less form: host in lower case without ``www.`` and default port, no fragment,
    no ``utm_`` or ``ref`` parameters, the rest in order, no slash at the end of the path."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.coalesce(full, F.lit(""))


def merged_headers(stored_headers: Column, revisit_headers: Column) -> Column:
    """The response's headers under those of the revisit that may replace them; names in lower case."""
    def low(m: Column) -> Column:
        return F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    allowed = F.array(*[F.lit(x) for x in UPDATED])
    over = F.filter(low(revisit_headers), lambda e: F.array_contains(allowed, e["key"]) & e["value"].isNotNull())
    names = F.transform(over, lambda e: e["key"])
    under = F.filter(low(stored_headers), lambda e: ~F.array_contains(names, e["key"]))
    entries = F.array_sort(F.concat(under, over))
    # of names that differ in case only, the last in order stays
    alone = F.filter(entries, lambda e, i: F.coalesce(F.try_element_at(entries, i + 2)["key"] != e["key"], F.lit(True)))
    return F.map_from_entries(alone)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits with the response they resolve to.

    ``records``: record_id long, kind string (response or revisit), url string,
    time long, digest string, headers map<string,string>.  Returns per revisit:
    record_id, canonical_url, time, response_id (the latest earlier response, agreeing or
    not), response_time, status (resolved, mismatch, unverified, no_response), digest
    (the response's, if resolved) and headers (merged, if resolved).
    """
    def header(name: str) -> Column:
        return F.get(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name), 0)["value"]

    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "time", "digest", "headers",
                       header("etag").alias("etag"), header("last-modified").alias("modified")).where("kind in ('response', 'revisit')")
    low, high = r.agg(F.min("time"), F.max("time")).first()
    low, width = low or 0, max(1.0, ((high or 0) - (low or 0) + 1) / SPANS)
    r = r.withColumn("span", F.coalesce(F.floor((F.col("time") - F.lit(low)) / F.lit(width)), F.lit(-1)).cast("int"))
    full = F.when((F.col("kind") == "response") & F.col("time").isNotNull(),
                  F.struct("time", F.col("record_id").alias("id"), "digest", "etag", "modified", "headers"))
    r = r.withColumn("full", full)
    # `range` before the row's own time: responses at the same time are not earlier
    near = Window.partitionBy("canonical_url", "span").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    inside = r.withColumn("near", F.max_by("full", F.struct("full.time", "full.id")).over(near))
    last = (r.where("full is not null").groupBy("canonical_url", "span")
            .agg(F.max_by("full", F.struct("full.time", "full.id")).alias("last")))
    spans = r.where("kind = 'revisit'").select("canonical_url", "span").distinct().join(last, ["canonical_url", "span"], "full")
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("last", True).over(before)).select("canonical_url", "span", "far")
    got = (inside.where("kind = 'revisit'").join(carried, ["canonical_url", "span"], "left")
           .withColumn("found", F.when(F.col("time").isNotNull(), F.coalesce("near", "far"))))
    agrees = (F.when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), F.col("etag") == F.col("found.etag"))
              .when(F.col("modified").isNotNull() & F.col("found.modified").isNotNull(), F.col("modified") == F.col("found.modified"))
              .when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest")))
    status = F.when(F.col("found").isNull(), "no_response").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    done = F.col("status") == "resolved"
    return got.withColumn("status", status).select(
        "record_id", "canonical_url", "time", F.col("found.id").alias("response_id"), F.col("found.time").alias("response_time"), "status",
        F.when(done, F.col("found.digest")).alias("digest"), F.when(done, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the column body of ``bodies`` (record_id unique, body) of the response, null if unresolved."""
    b = bodies.select(F.col("record_id").alias("_id"), "body")
    return resolved.join(b, (F.col("response_id") == F.col("_id")) & (F.col("status") == "resolved"), "left").drop("_id")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Records of two crawls of ``pages``: a response for each page at time page_id, and a
    revisit at time 1,000,000 + page_id with the entity tag of the page's own html.
    A page whose canonical url was captured again later with another body thus meets another tag."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("bytes"))
    kinds = F.explode(F.array(F.lit("response"), F.lit("revisit")))
    both = base.withColumn("kind", kinds)
    is_full = F.col("kind") == "response"
    time = F.when(is_full, F.col("page_id")).otherwise(F.col("page_id") + 1_000_000)
    headers = F.when(is_full, F.create_map(F.lit("ETag"), F.col("tag"), F.lit("Content-Length"), F.col("bytes"), F.lit("Date"), time.cast("string"))).otherwise(
        F.create_map(F.lit("etag"), F.col("tag"), F.lit("Content-Length"), F.lit("0"), F.lit("date"), time.cast("string")))
    return both.select(F.when(is_full, F.col("page_id")).otherwise(-1 - F.col("page_id")).alias("record_id"), "kind", "url",
                       time.alias("time"), F.when(is_full, F.col("tag")).alias("digest"), headers.alias("headers"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select((-1 - F.col("record_id")).alias("page_id"), "canonical_url", "response_id", "response_time", "status", "digest",
                      F.col("headers")["content-length"].cast("long").alias("n_bytes"), F.col("headers")["date"].alias("header_date"), F.size("headers").alias("n_headers"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, octet_length(encode(coalesce(html, ''))) AS n,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS q
  FROM pages),
c AS (SELECT page_id, tag, n, coalesce(host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END, '') AS u FROM p),
ev AS (SELECT u, page_id AS t, 'response' AS kind, page_id, tag, n FROM c
  UNION ALL SELECT u, page_id + 1000000, 'revisit', page_id, tag, n FROM c),
w AS (SELECT *, max(CASE WHEN kind = 'response' THEN t END) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rt FROM ev)
SELECT w.page_id, w.u AS canonical_url, r.page_id AS response_id, w.rt AS response_time,
  CASE WHEN w.rt IS NULL THEN 'no_response' WHEN r.tag = w.tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN r.tag = w.tag THEN r.tag END AS digest,
  CASE WHEN r.tag = w.tag THEN r.n END AS n_bytes,
  CASE WHEN r.tag = w.tag THEN CAST(w.t AS VARCHAR) END AS header_date,
  CASE WHEN r.tag = w.tag THEN 3 END AS n_headers
FROM w LEFT JOIN ev r ON r.u = w.u AND r.t = w.rt AND r.kind = 'response'
WHERE w.kind = 'revisit'
"""

QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": OP4_SQL}
