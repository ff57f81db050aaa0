"""Not-modified revisits of a web archive, resolved to the full response they stand for.

A revisit is joined as of its time with the latest earlier full response of its canonical URL.
Its validators decide whether it may take over that response; its permitted headers replace the
response's, as a cache does when it updates a stored response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._asof import latest_earlier

#: Headers that a 304 response may carry for the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without www. and default port, tracking
    parameters (utm_*, ref, fbclid, gclid) dropped and the others sorted, no closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", "")
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(etag: Column) -> Column:
    """An entity tag without its weakness mark: revisits are compared weakly."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, response_id, outcome, headers.

    records: record_id, url, ts (integer), kind ('response' or 'revisit'), status, headers (map of
    lower-case names). Full responses are responses with status 200. The latest earlier one of the
    same canonical URL is taken, of several at that time the one with the largest id. outcome is
    `resolved` if the entity tags agree weakly, or, where the revisit has none, the modification
    times; `modified` if they differ; `unverified` if the revisit has no validator that the
    response has too; `missing` without a response. headers is then the response's map with the
    revisit's permitted headers put over it; otherwise the revisit's own.

    Null URLs and times find nothing and are `missing`; null header maps are empty. A revisit that
    is repeated comes back once each; a response id should be unique, of repeated ones one is
    taken. Other columns are ignored; no rows give none.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "status", F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    wanted = rows.filter(full | (F.col("kind") == "revisit")).select("record_id", "url_key", "ts", "kind", F.when(F.col("kind") == "revisit", F.col("headers")).alias("headers"))
    asof = latest_earlier(wanted, ["url_key"], "ts", F.when(F.col("kind") == "response", F.col("record_id"))).filter("kind = 'revisit'")
    stored = rows.filter(full).groupBy(F.col("record_id").alias("response_id")).agg(F.any_value("headers").alias("stored"))
    met = asof.join(stored, F.col("found") == F.col("response_id"), "left")
    mine, theirs = F.col("headers"), F.col("stored")
    verdict = (
        F.when(F.col("response_id").isNull(), "missing")
        .when(mine["etag"].isNotNull() & theirs["etag"].isNotNull(), F.when(_tag(mine["etag"]) == _tag(theirs["etag"]), "resolved").otherwise("modified"))
        .when(mine["etag"].isNull() & mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("modified"))
        .otherwise("unverified")
    )
    met = met.withColumn("outcome", verdict)
    permitted = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    return met.select("record_id", "url_key", "response_id", "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(mine).alias("headers"))
