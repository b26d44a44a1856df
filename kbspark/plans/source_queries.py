"""Queries over scans, sources, sinks and jobs (S, and the filters and sets beside them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.operators import pages as pg
from kbspark.plans import views as v
from kbspark.plans.views import with_views
from kbspark.session import scratch, table
from kbspark.sources import files, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _source_files(spark: SparkSession, sf: str) -> DataFrame:
    """The sources as files named by digest with their sidecars, scanned."""
    path = scratch(spark)
    files.store_files(v.sources(spark, sf), path, files.FAN)
    return files.scan_sources(spark, path)


@query(with_views("select digest, arrival, strlen(data) as size from sources", "sources"))
def source_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored file: its stem is the digest, which its bytes must have."""
    found = _source_files(spark, sf)
    intact = F.sha2("content", 256) == F.col("digest")
    return found.where(intact).select("digest", F.col("provenance")["arrival"].cast("long").alias("arrival"), "size")


@query("select page_id, url, sha256(html) as html_sha256, length(html) as n_chars from pages")
def page_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Page files as bytes, decoded with invalid sequences replaced."""
    path, pages = scratch(spark), table(spark, sf, "pages")
    # Numbers begin alike, so a hash stands before them and says the folder.
    name = F.concat(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, files.FAN), F.lit("-"), "page_id", F.lit(".md"))
    files.write_files(pages.select(name.alias("name"), F.col("html").cast("binary").alias("data")), path, files.FAN)
    found = files.scan_pages(spark, path).where("fault is null")
    found = found.select(F.substring_index(F.substring_index("name", ".", 1), "-", -1).cast("long").alias("page_id"), F.sha2(F.col("text").cast("binary"), 256).alias("html_sha256"), F.length("text").cast("long").alias("n_chars"))
    return found.join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "html_sha256", "n_chars")


@query(with_views("select arrival, digest, job, url, status from stored", "stored"))
def store_sources(spark: SparkSession, sf: str) -> DataFrame:
    return store.store_sources(v.raw(spark, sf)).select("arrival", "digest", "job", "url", "status")


@query(with_views("select digest, url, fetched, content_type, job from sources", "sources"))
def provenance_read(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars as records."""
    p = F.col("provenance")
    return _source_files(spark, sf).select("digest", *[p[c].alias(c) for c in ("url", "fetched", "content_type", "job")])


@query(with_views(r""", used as (select distinct split_part(i, ':', 1) as key from (select unnest(identifiers) as i from summaries))
select u.key, d.pattern, d.about as "describe", coalesce('- ' || d.key || ': ' || d.about, '- ' || u.key || ': not declared') as prompt_line
from used u left join (values ('term', '[A-Za-z]{14,17}', 'long word')) d(key, pattern, about) on d.key = u.key""", "summaries"))
def config_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary beside the identifier keys that pages use."""
    used = v.summaries(spark, sf).select(F.explode("identifiers").alias("i")).select(t.key_of(F.col("i")).alias("key")).distinct()
    out = used.join(v.vocab(spark, "email"), "key", "left")
    line = F.when(F.col("describe").isNotNull(), F.concat(F.lit("- "), "key", F.lit(": "), "describe")).otherwise(F.concat(F.lit("- "), "key", F.lit(": not declared")))
    return out.select("key", "pattern", "describe", line.alias("prompt_line"))


@query(with_views("select arrival, '## [' || status || '] ' || url || ' - ' || fetched as entry from stored", "stored"))
def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """One entry an action, appended to the log table and read back."""
    path = scratch(spark)
    rows = store.store_sources(v.raw(spark, sf))
    for status in ("new", "exists", "failed"):
        entry = store.log_entries(status, F.col("url"), F.col("fetched"))
        rows.where(F.col("status") == status).select("arrival", entry.alias("entry")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(with_views("select name, sha256(text) as text_sha256, length(text) as n_chars from texts", "texts"))
def page_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered pages written by kind and read back."""
    path = scratch(spark)
    v.texts(spark, sf).withColumn("part", F.substring_index("name", "-", 1)).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).select("name", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


JOBS = """, items as (select source as feed_id, 'https://' || source || '.example.org/d/' || doc_id || '?b=' || (doc_id % 7) || '&gclid=1#f' as url, doc_id from documents where source is not null),
jobs as (select source as job, case when r % 4 <> 1 then source end as feed, case when r % 4 = 1 or r % 4 = 3 then ['https://' || source || '.example.org/list?utm_medium=a&q=x%20y', 'https://' || source || '.example.org/list/2'] end as urls,
   case r % 3 when 0 then 'partial' when 1 then 'full' end as mode from (select source, row_number() over (order by source) as r from (select distinct source from documents where source is not null))),
seen as (select 'https://' || job || '.example.org/d/' || arrival || '?b=' || (arrival % 7) as clean_url from raw where arrival % 2 = 0),
good as (select * from jobs where (feed is null) <> (urls is null)),
wanted as (select g.job, g.mode, i.url, 'https://' || i.feed_id || '.example.org/d/' || i.doc_id || '?b=' || (i.doc_id % 7) as clean_url from good g join items i on i.feed_id = g.feed
   union all select job, mode, u, replace(replace(u, 'utm_medium=a&', ''), '%20', '+') from (select job, mode, unnest(urls) as u from good))"""


def _jobs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").where("source is not null")
    host = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"))
    items = docs.select(F.col("source").alias("feed_id"), F.concat(host, F.lit("d/"), "doc_id", F.lit("?b="), F.col("doc_id") % 7, F.lit("&gclid=1#f")).alias("url"))
    named = docs.select("source").distinct().withColumn("r", F.row_number().over(Window.orderBy("source")))
    r = F.col("r")
    urls = F.array(F.concat(host, F.lit("list?utm_medium=a&q=x%20y")), F.concat(host, F.lit("list/2")))
    jobs = named.select(F.col("source").alias("job"), F.when(r % 4 != 1, F.col("source")).alias("feed"), F.when((r % 4 == 1) | (r % 4 == 3), urls).alias("urls"), F.when(r % 3 == 0, "partial").when(r % 3 == 1, "full").alias("mode"))
    return jobs, items, v.raw(spark, sf).where("arrival % 2 = 0").select("url")


@query(with_views(JOBS + """ select job, url, clean_url, null as fault from wanted w where mode = 'full' or clean_url not in (select clean_url from seen)
union all select job, null, null, case when feed is not null then 'both feed and urls' else 'neither feed nor urls' end from jobs where (feed is null) = (urls is null)""", "raw"))
def job_plan(spark: SparkSession, sf: str) -> DataFrame:
    return store.plan_jobs(*_jobs(spark, sf))


@query(with_views(JOBS + " select job, clean_url from wanted where mode is distinct from 'full' and clean_url not in (select clean_url from seen)", "raw"))
def partial_job(spark: SparkSession, sf: str) -> DataFrame:
    jobs, items, seen = _jobs(spark, sf)
    return store.plan_jobs(jobs.where("mode is null or mode = 'partial'"), items, seen).where("fault is null").select("job", "clean_url")


@query("select doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f\\x{85}\\x{2028}\\x{2029}]', ' ', 'g') as flat from documents")
def flatten_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.flatten_text(F.coalesce("text", F.lit(""))).alias("flat"))


@query(with_views("""select arrival, case content_type when 'text/html; charset=UTF-8' then 'text/html' when 'text/plain' then 'text/plain' when ' Application/PDF' then 'application/pdf' when 'image/PNG' then 'image/png'
 else case arrival % 3 when 0 then 'text/html' when 1 then 'text/markdown' else 'text/plain' end end as media_type from raw""", "raw"))
def media_type(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("arrival") % 3
    url = F.concat(F.lit("https://x.org/a"), F.when(a == 0, ".HTML?q=.md").when(a == 1, ".md#x").otherwise("/b.d/c"))
    return v.raw(spark, sf).select("arrival", t.media_type(F.col("content_type"), url).alias("media_type"))


@query("""with p as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as base, string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&') as q from pages),
k as (select *, list_filter(q, lambda x: x <> '' and not (lower(x) like 'utm\\_%' escape '\\' or lower(split_part(x, '=', 1)) in ('ref', 'fbclid', 'gclid'))) as kept from p)
select page_id, base || case when len(kept) > 0 then '?' || array_to_string(list_transform(kept, lambda x: case when contains(x, '=') then x else x || '=' end), '&') else '' end as clean_url from k""")
def clean_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.clean_url(F.col("url")).alias("clean_url"))


@query("select page_id, regexp_matches(url, '^https?:') as is_http, false as is_text from pages")
def url_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.is_url(F.upper("url")).alias("is_http"), t.is_url(F.col("html")).alias("is_text"))


@query(with_views("""select arrival, case when m = 'image/png' then 'attachment' when m = 'application/pdf' then 'actionable: pdf disabled' when strlen(data) > 1000000 then 'actionable: too large' else 'text' end as route
from (select *, coalesce(lower(trim(split_part(content_type, ';', 1))), 'text/plain') as m from raw)""", "raw"))
def source_route(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw(spark, sf).select("arrival", store.route(F.col("data").cast("binary"), F.col("content_type"), F.col("url")).alias("route"))


@query(with_views("select arrival, job from raw where data = ''", "raw"))
def empty_sources(spark: SparkSession, sf: str) -> DataFrame:
    return store.store_sources(v.raw(spark, sf)).where("status = 'failed'").select("arrival", "job")


@query("select doc_id, strlen(coalesce(text, '')) * 2048 > 10485760 as refused from documents")
def attachment_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as image attachments under a cap 2048 times less: those over it are refused."""
    sent = store.route(F.coalesce("text", F.lit("")).cast("binary"), F.lit("image/png"), F.lit("u"), attachment_cap=store.ATTACHMENT_CAP // 2048)
    return table(spark, sf, "documents").select("doc_id", (sent == "actionable: too large").alias("refused"))


@query(with_views("select job, count(*) filter (where status = 'new') as n_new, count(*) filter (where status = 'exists') as n_exists, count(*) filter (where status = 'failed') as n_failed from stored group by job", "stored"))
def ingest_tally(spark: SparkSession, sf: str) -> DataFrame:
    return store.tally(store.store_sources(v.raw(spark, sf)))


@query(with_views("select digest, arrival, url from (select *, row_number() over (partition by digest order by arrival) as n from raw where data <> '') where n = 1", "raw"))
def first_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return store.store_sources(v.raw(spark, sf)).where("status = 'new'").select("digest", "arrival", "url")


@query(with_views("select distinct url from sources", "sources"))
def distinct_urls(spark: SparkSession, sf: str) -> DataFrame:
    return store.stored_urls(v.sources(spark, sf))


SUMMARISED = "(select source from summaries where arrival % 4 <> 0)"


def _summarised(spark: SparkSession, sf: str) -> DataFrame:
    return v.summaries(spark, sf).where("arrival % 4 <> 0")


@query(with_views(f"select digest from sources where digest not in {SUMMARISED}", "summaries"))
def unsummarized(spark: SparkSession, sf: str) -> DataFrame:
    done = _summarised(spark, sf).select(F.col("source").alias("digest"))
    return v.sources(spark, sf).select("digest").join(done, "digest", "left_anti")


@query(with_views("select digest from sources except select source from summaries where arrival % 4 <> 0", "summaries"))
def except_sources(spark: SparkSession, sf: str) -> DataFrame:
    return v.sources(spark, sf).select("digest").exceptAll(_summarised(spark, sf).select("source"))


@query(with_views("""select o.digest, case when s.source is null then 'no page' else 'prompt changed' end as reason from sources o
left join (select source, prompt_fingerprint from summaries where arrival % 4 <> 0) s on s.source = o.digest where s.prompt_fingerprint is distinct from 'fp1'""", "summaries"))
def summarize_plan(spark: SparkSession, sf: str) -> DataFrame:
    have = _summarised(spark, sf).select(F.col("source").alias("digest"), F.col("prompt_fingerprint").alias("had"))
    plan = v.sources(spark, sf).select("digest").join(have, "digest", "left").where(~F.col("had").eqNullSafe("fp1"))
    return plan.select("digest", F.when(F.col("had").isNull(), "no page").otherwise("prompt changed").alias("reason"))


@query(with_views("""select coalesce(a.digest, b.digest) as path, case when b.digest is null then 'added' else 'changed' end as change from
(select digest, job from sources) a left join (select digest, case when arrival % 10 = 3 then 'other' else job end as job from sources where arrival % 5 <> 0) b using (digest)
where a.job is distinct from b.job and not (a.job = 'src0')""", "sources"))
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Paths added or changed since a snapshot, but for those of an allowed kind."""
    now = v.sources(spark, sf).select("digest", "job", "arrival")
    then = now.where("arrival % 5 <> 0").select("digest", F.when(F.col("arrival") % 10 == 3, "other").otherwise(F.col("job")).alias("was"))
    diff = now.join(then, "digest", "full_outer").where(F.col("job").isNotNull() & ~F.col("job").eqNullSafe(F.col("was")))
    allowed = diff.where("job = 'src0'").select("digest")
    return diff.join(allowed, "digest", "left_anti").select(F.col("digest").alias("path"), F.when(F.col("was").isNull(), "added").otherwise("changed").alias("change"))


@query("""with d as (select doc_id, coalesce(source, 'none') || '/' || (doc_id // 20000) as feed_id, coalesce(try_cast(substr(source, 4) as int), 0) % 4 as shape,
  trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[\\x00-\\x1f<>&"\\\\]', ' ', 'g')) as title from documents)
select feed_id, (row_number() over (partition by feed_id order by doc_id) - 1)::int as pos, 'https://x.org/' || doc_id as url, title, null as error from d where shape < 3
union all select distinct feed_id, null, null, null, 'json without items' from d where shape = 3""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of three kinds made of the documents of each source, exploded to items; faults are rows."""
    from kbspark.sources.extract import feed_items as explode_feeds

    docs = table(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    url = F.concat(F.lit("https://x.org/"), F.col("doc_id"))
    title = F.trim(F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), r'[\x00-\x1f<>&"\\]', " "))
    shape = F.coalesce(F.substring("source", 4, 20).try_cast("int"), F.lit(0)) % 4
    rss = F.concat(F.lit("<item><link>"), url, F.lit("</link><title>"), title, F.lit("</title></item>"))
    atom = F.concat(F.lit('<entry><link href="'), url, F.lit('"/><title>'), title, F.lit("</title></entry>"))
    item = F.concat(F.lit('{"url":"'), url, F.lit('","title":"'), title, F.lit('"}'))
    rows = docs.select("source", "doc_id", shape.alias("shape"), F.when(shape == 0, rss).when(shape == 1, atom).otherwise(item).alias("x"))
    # One feed for every thousand documents of a source, so that a feed stays a document.
    rows = rows.withColumn("feed_id", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 20000)))
    feeds = rows.groupBy("feed_id", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda s: s["x"]), "\x01").alias("x"))
    s, x = F.col("shape"), F.col("x")
    plain, commas = F.replace(x, F.lit("\x01"), F.lit("")), F.replace(x, F.lit("\x01"), F.lit(","))
    data = (
        F.when(s == 0, F.concat(F.lit('<rss version="2.0"><channel>'), plain, F.lit("</channel></rss>")))
        .when(s == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), plain, F.lit("</feed>")))
        .when(s == 2, F.concat(F.lit('{"items":['), commas, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"entries":['), commas, F.lit("]}")))
    )
    return explode_feeds(feeds.select("feed_id", data.cast("binary").alias("data")))


@query(None)
def extract_text(spark: SparkSession, sf: str) -> DataFrame:
    from kbspark.sources.extract import extract_text as extract

    pages = table(spark, sf, "pages").select("page_id", F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").cast("binary").alias("data"))
    return extract(pages, "page_id")
