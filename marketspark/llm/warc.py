"""Not-modified revisits of a web archive, resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Header fields that a not-modified answer may replace.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICE = 3600  # seconds


def canonical_url(url: Column) -> Column:
    """Lower-cased host without ``www.``, path without trailing slash, query without tracking fields."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"^[A-Za-z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike("^(utm_|ref=)"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per row of ``records(record_id, url, at, kind, headers, body_chars)``.

    ``at`` is in epoch seconds, ``kind`` is ``response`` or ``revisit``, ``headers`` a map by
    lower-case name. A revisit meets the latest full response of its canonical URL that is earlier;
    of equal times the larger record id. It is ``resolved`` if the etag (weak form alike) or, without
    one, last-modified is the same, ``mismatch`` if not, ``orphan`` if there is none; records without
    time or kind are ``unusable``. A resolved one has the response's headers with the permitted ones
    of its own. The latest response is carried within slices of time and then from slice to slice,
    so a URL that has a third of all records spreads over its slices; bodies never move.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", "headers", "body_chars").withColumn("slice", F.floor(F.col("at") / SLICE))
    full = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), F.struct("at", "record_id", "headers", "body_chars"))
    r = r.withColumn("full", full)
    here = Window.partitionBy("canonical", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = r.withColumn("near", F.max(F.struct("full.at", "full.record_id")).over(here))
    per = r.where("full is not null").groupBy("canonical", "slice").agg(F.max(F.struct("at", "record_id")).alias("last"))
    slices = r.select("canonical", "slice").distinct().join(per, ["canonical", "slice"], "left")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("far", F.last("last", True).over(before)).select(F.col("canonical").alias("c"), F.col("slice").alias("s"), "far")
    joined = inside.join(carried, (F.col("canonical") == F.col("c")) & F.col("slice").eqNullSafe(F.col("s")), "left")
    of = F.when(F.col("near.record_id").isNotNull(), F.col("near.record_id")).otherwise(F.col("far.record_id"))
    asked = joined.withColumn("of", F.when((F.col("kind") == "revisit") & F.col("at").isNotNull(), of))
    bodies = r.where("full is not null").dropDuplicates(["record_id"]).select(F.col("record_id").cast("string").alias("body_key"), F.col("headers").alias("base"), F.col("body_chars").alias("base_chars"))
    # Records that ask for no body get a key of their own: as nulls they would all meet in one task.
    asked = asked.withColumn("of_key", F.coalesce(F.col("of").cast("string"), F.concat_ws(" ", F.lit("none"), F.col("record_id").cast("string"))))
    found = asked.join(bodies, F.col("of_key") == F.col("body_key"), "left")
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    same = F.coalesce(
        F.when(tag(F.col("headers")).isNotNull(), tag(F.col("headers")) == tag(F.col("base"))).otherwise(F.element_at("headers", "last-modified") == F.element_at("base", "last-modified")),
        F.lit(False),
    )
    state = (
        F.when(F.col("at").isNull() | F.col("kind").isNull() | ~F.col("kind").isin("response", "revisit"), "unusable").when(F.col("kind") == "response", "full")
        .when(F.col("of").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    )
    own = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.when(F.col("state") == "resolved", F.map_concat(F.map_filter("base", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False))), own)).otherwise(F.col("headers"))
    return found.withColumn("state", state).select(
        "record_id", "canonical", "state", F.when(F.col("state") == "resolved", F.col("of")).alias("resolved_id"), merged.alias("headers"),
        F.when(F.col("state") == "resolved", F.col("base_chars")).when(F.col("state") == "full", F.col("body_chars")).alias("body_chars"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records over ``pages``: a full response of each page, and a later revisit of its URL whose
    etag is the page's, or for every fifth page another one."""
    day = 86_400
    body = F.md5(F.coalesce("html", F.lit("")))
    page = pages.select("page_id", "url", body.alias("tag"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("chars"))
    first = page.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), "tag", F.lit("content-type"), F.lit("text/html"), F.lit("date"), (F.col("page_id") * 60).cast("string")).alias("headers"), F.col("chars").alias("body_chars"),
    )
    later = page.select(
        (F.col("page_id") * 2 + 1), "url", F.col("page_id") * 60 + day, F.lit("revisit"),
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), "tag")), F.lit("content-type"), F.lit("ignored"), F.lit("date"), (F.col("page_id") * 60 + day).cast("string")), F.lit(0).cast("long"),
    )
    return first.union(later)


def query(pages: DataFrame) -> DataFrame:
    return resolve_revisits(captures(pages)).select(
        "record_id", "canonical", "state", "resolved_id", F.element_at("headers", "etag").alias("etag"), F.element_at("headers", "content-type").alias("content_type"), F.element_at("headers", "date").alias("date_sent"), "body_chars"
    )


SQL = r"""
with p as (select page_id, url, md5(coalesce(html,'')) as tag, length(coalesce(html,'')) as chars from pages),
u as (select *, regexp_replace(regexp_replace(coalesce(url,''), '#.*$', ''), '^[A-Za-z]+://', '') as rest from p),
c as (select *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as hp,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_|ref=)'))), '&') as q from u),
k as (select *, hp || case when q <> '' then '?' || q else '' end as canonical from c),
v as (select k.*, k.page_id * 60 + 86400 as sent, case when k.page_id % 5 = 0 then 'other' else tag end as asked,
             (select max((f.page_id * 60, f.page_id * 2)) from k f where f.canonical = k.canonical and f.page_id * 60 < k.page_id * 60 + 86400)[2] as of from k),
j as (select v.*, f.tag as base_tag, f.chars as base_chars, coalesce(f.tag = v.asked, false) as same from v left join k f on f.page_id * 2 = v.of)
select page_id * 2 as record_id, canonical, 'full' as state, cast(null as bigint) as resolved_id, tag as etag, 'text/html' as content_type, cast(page_id * 60 as varchar) as date_sent, chars as body_chars from k
union all
select page_id * 2 + 1, canonical, case when of is null then 'orphan' when same then 'resolved' else 'mismatch' end, case when same then of end,
       case when page_id % 5 = 0 then 'other' else 'W/' || tag end, case when same then 'text/html' else 'ignored' end, cast(sent as varchar), case when same then base_chars end from j
"""
