"""The given tables as sources, pages, vectors and logs; for each view, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import configure, materialise, table
from kbspark.sources.store import store_sources

VOCAB = [("term", "[A-Za-z]{14,17}", "long word"), ("email", r"[^@\s]+@[^@\s]+", "mail address")]


_kept: ContextVar[dict | None] = ContextVar("kept", default=None)


def kept_once(f: Callable) -> Callable:
    """A query in which each view marked `once` is computed at most once, as a table in the shared folder."""

    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if _kept.get() is not None:
            return f(spark, sf)
        held = _kept.set({})
        try:
            return f(spark, sf)
        finally:
            _kept.reset(held)

    return run


def once(view: Callable) -> Callable:
    """A view that a query marked `kept_once` reads from a table; in others it is a plan like any."""

    @wraps(view)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        held = _kept.get()
        if held is None:
            return view(spark, sf)
        if (view.__name__, sf) not in held:
            held[view.__name__, sf] = materialise(view(spark, sf))
        return held[view.__name__, sf]

    return run


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """documents as fetched sources; arrival is doc_id."""
    configure(spark)
    return raw_of(table(spark, sf, "documents"))


def raw_of(docs: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("text/html; charset=UTF-8", "text/plain", " Application/PDF", "image/PNG")], F.lit(None).cast("string"))
    job = F.coalesce("source", F.lit("none"))
    host = F.concat(F.lit("https://"), job, F.lit(".example.org/d/"), F.col("doc_id"))
    minutes = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return docs.select(
        F.col("doc_id").alias("arrival"),
        F.coalesce("text", F.lit("")).alias("data"),
        F.concat(host, F.lit("?utm_source=feed&b="), F.col("doc_id") % 7, F.lit("&ref=x#top")).alias("url"),
        F.date_format(minutes, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("content_type"),
        job.alias("job"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return store_sources(raw(spark, sf)).where("status = 'new'").drop("status")


def title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "[^A-Za-z0-9 .,]", ""))


def _said(text: Column) -> tuple[Column, Column]:
    """(title, identifiers) of a text: its first line's ASCII text, long words and addresses."""
    terms = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]{14,}+)"), F.lit(1)), lambda w: F.concat(F.lit("term:"), w))
    # The search for addresses is dear and few texts have one; finding "@mail" is cheap.
    found = F.when(F.contains(text, F.lit("@mail")), F.regexp_extract_all(text, F.lit(r"([a-z]+\.[0-9]{2}@mail[0-9]\.example\.com)"), F.lit(1)))
    mails = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: F.concat(F.lit("email:"), m))
    return title(text), F.array_sort(F.array_distinct(F.concat(terms, mails)))


@once
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A summary page for each source: its first line's ASCII text as title, long words and addresses as identifiers, the whole text as body."""
    text = F.col("data")
    titled, identifiers = _said(text)
    stem = F.concat(F.lit("s-"), F.substring("digest", 1, 12))
    return sources(spark, sf).select(
        F.concat(stem, F.lit(".md")).alias("name"),
        stem.alias("stem"),
        F.lit("summary").alias("kind"),
        titled.alias("title"),
        identifiers.alias("identifiers"),
        F.col("digest").alias("source"),
        F.col("url").alias("source_url"),
        "fetched",
        F.concat(F.lit("fp"), F.col("arrival") % 3).alias("prompt_fingerprint"),
        text.alias("body"),
        "arrival",
    )


@once
def light(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries without their bodies, their jobs and the bytes of their bodies: texts are read where they lie, once, and none is shuffled."""
    titled, identifiers = _said(F.col("data"))
    row = F.struct("arrival", "fetched", "job", titled.alias("title"), identifiers.alias("identifiers"), F.octet_length("data").alias("bytes"))
    rows = raw(spark, sf).where("data <> ''").select(F.sha2(F.col("data").cast("binary"), 256).alias("digest"), row.alias("row"))
    # The first arrival of a digest, one without a number last; copies are combined before the shuffle.
    first = F.struct(F.col("row.arrival").isNull(), F.col("row.arrival"))
    return rows.groupBy("digest").agg(F.min_by("row", first).alias("row")).select("digest", "row.*")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """An agent page for each conversation, linking the source of the same number, a title, another note and nothing."""
    talk = table(spark, sf, "conversations")
    said = talk.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "\n").alias("said"))
    linked = summaries(spark, sf).select(F.col("arrival").alias("conv_id"), F.col("stem").alias("to_stem"), F.col("title").alias("to_title"))
    notes = said.join(linked, "conv_id", "left")
    c = F.col("conv_id") % 4
    link = F.when(c == 0, F.col("to_stem")).when(c == 1, F.col("to_title")).when(c == 2, F.lit("note-1")).otherwise(F.lit("nowhere"))
    return notes.select(
        F.concat(F.lit("note-"), F.col("conv_id"), F.lit(".md")).alias("name"),
        F.concat(F.lit("note-"), F.col("conv_id")).alias("stem"),
        F.lit("note").alias("kind"),
        F.concat(F.lit("Note "), F.col("conv_id") % 50).alias("title"),
        F.array(F.concat(F.lit("conv:"), F.col("conv_id")), F.lit("term:")).alias("identifiers"),
        F.concat(F.lit("See [["), F.coalesce(link, F.lit("gone")), F.lit("#part|that]].\n"), F.col("said")).alias("body"),
        "conv_id",
    )


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """A story for each job and day: all sources that the job fetched in hours of placing, every second hour.

    Every third job has a member without summary; what came in the other hours is not placed
    yet. A story holds no more than a job fetches in a day, however long the table.
    """
    # A query that keeps the light rows has the sources there; in others no text is looked into.
    known = light(spark, sf) if ("light", sf) in (_kept.get() or {}) else sources(spark, sf)
    placed = known.where("arrival div 60 % 2 = 0").select("job", F.expr("arrival div 1440").alias("day"), "arrival", "digest")
    grouped = placed.groupBy("job", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "digest"))), lambda s: s["digest"]).alias("members"))
    lost = F.when(F.length("job") % 3 == 2, F.array(F.sha2(F.col("job").cast("binary"), 256))).otherwise(F.array().cast("array<string>"))
    return grouped.select(
        F.concat(F.lit("story-"), F.col("job"), F.lit("-"), F.col("day"), F.lit(".md")).alias("name"),
        F.concat(F.lit("story-"), F.col("job"), F.lit("-"), F.col("day")).alias("stem"),
        F.lit("story").alias("kind"),
        F.concat(F.lit("Story of "), F.col("job")).alias("title"),
        F.concat("members", lost).alias("members"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(name, text): every summary and note as a page file; each 11th note lacks the end of its frontmatter."""
    from kbspark.operators.pages import render

    def field(column: str, is_list: bool = False):
        none = F.lit(None).cast("array<string>")
        return F.struct(F.lit(None).cast("string").alias("scalar") if is_list else F.col(column).alias("scalar"), (F.col(column) if is_list else none).alias("list"))

    def page(df: DataFrame, names: list[str]):
        keys = F.array(*[F.lit(n) for n in names])
        fields = F.map_from_arrays(keys, F.array(*[field(n, n == "identifiers") for n in names]))
        return render(keys, fields, F.col("body"))

    s = summaries(spark, sf)
    s = s.select("name", page(s, ["kind", "title", "identifiers", "source", "source_url", "fetched", "prompt_fingerprint"]).alias("text"))
    n = notes(spark, sf)
    text = page(n, ["kind", "title", "identifiers"])
    n = n.select("name", F.when(F.col("conv_id") % 11 == 0, F.replace(text, F.lit("\n---\n"), F.lit("\n--\n"))).otherwise(text).alias("text"))
    return s.unionByName(n)


@once
def pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with their columns, as the quality checks read them."""
    empty = F.array().cast("array<string>")
    s = summaries(spark, sf).select("name", "stem", "kind", "title", "identifiers", "source", empty.alias("members"), "body", F.lit(True).alias("parsed_ok"))
    n = notes(spark, sf).select("name", "stem", "kind", "title", "identifiers", F.lit("").alias("source"), empty.alias("members"), "body", (F.col("conv_id") % 11 != 0).alias("parsed_ok"))
    t = stories(spark, sf).select("name", "stem", "kind", "title", empty.alias("identifiers"), F.lit("").alias("source"), "members", F.lit("").alias("body"), F.lit(True).alias("parsed_ok"))
    return s.unionByName(n).unionByName(t)


def vocab(spark: SparkSession, *without: str) -> DataFrame:
    return spark.createDataFrame([v for v in VOCAB if v[0] not in without], "key string, pattern string, describe string")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id"), F.lit(".md")).alias("name"), F.concat(F.lit("k"), F.col("label")).alias("kind"), F.concat(F.lit("Vector "), F.col("vec_id")).alias("title"), "embedding", "vec_id")


CTE = {
    "raw": """raw as (select doc_id as arrival, coalesce(text, '') as data, sha256(coalesce(text, '')) as digest,
  'https://' || coalesce(source, 'none') || '.example.org/d/' || doc_id || '?utm_source=feed&b=' || (doc_id % 7) || '&ref=x#top' as url,
  strftime(timestamp '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') as fetched,
  ['text/html; charset=UTF-8', 'text/plain', ' Application/PDF', 'image/PNG', null][doc_id % 5 + 1] as content_type,
  coalesce(source, 'none') as job from documents)""",
    "stored": """stored as (select *, case when data = '' then 'failed' when row_number() over (partition by digest order by arrival) > 1 then 'exists' else 'new' end as status from raw)""",
    "sources": """sources as (select * exclude (status) from stored where status = 'new')""",
    "summaries": r"""summaries as (select 's-' || digest[1:12] || '.md' as name, 's-' || digest[1:12] as stem, 'summary' as kind,
  trim(regexp_replace(split_part(data, chr(10), 1), '[^A-Za-z0-9 .,]', '', 'g')) as title,
  list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(data, '[A-Za-z]{14,}'), lambda w: 'term:' || w),
    list_transform(regexp_extract_all(data, '[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com'), lambda m: 'email:' || m)))) as identifiers,
  digest as source, url as source_url, fetched, 'fp' || (arrival % 3) as prompt_fingerprint, data as body, arrival from sources)""",
    "notes": """notes as (select 'note-' || t.conv_id || '.md' as name, 'note-' || t.conv_id as stem, 'note' as kind, 'Note ' || (t.conv_id % 50) as title,
  ['conv:' || t.conv_id, 'term:'] as identifiers,
  'See [[' || coalesce(case t.conv_id % 4 when 0 then s.stem when 1 then s.title when 2 then 'note-1' else 'nowhere' end, 'gone') || '#part|that]].' || chr(10) || said as body, t.conv_id
  from (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, role, coalesce(text, '')) as said from conversations group by conv_id) t
  left join summaries s on s.arrival = t.conv_id)""",
    "stories": """stories as (select 'story-' || job || '-' || day || '.md' as name, 'story-' || job || '-' || day as stem, 'story' as kind, 'Story of ' || job as title,
  list_concat(list(digest order by arrival), case when length(job) % 3 = 2 then [sha256(job)] else [] end) as members
  from (select job, digest, arrival, arrival // 1440 as day from sources where (arrival // 60) % 2 = 0) group by job, day)""",
    "pages": """kb_pages as (select name, stem, kind, title, identifiers, source, []::varchar[] as members, body, true as parsed_ok from summaries
  union all select name, stem, kind, title, identifiers, '', []::varchar[], body, conv_id % 11 <> 0 from notes
  union all select name, stem, kind, title, []::varchar[], '', members, '', true from stories)""",
    "vectors": """vectors as (select 'v' || vec_id || '.md' as name, 'k' || label as kind, 'Vector ' || vec_id as title, embedding, vec_id from embeddings)""",
    "texts": """texts as (select name, '---' || chr(10) || 'kind: summary' || chr(10) || 'title: ' || title || chr(10) || ids(identifiers) || chr(10) || 'source: ' || source || chr(10) || 'source_url: ' || source_url || chr(10) || 'fetched: ' || fetched || chr(10) || 'prompt_fingerprint: ' || prompt_fingerprint || chr(10) || '---' || chr(10) || chr(10) || body as text from summaries
  union all select name, '---' || chr(10) || 'kind: note' || chr(10) || 'title: ' || title || chr(10) || ids(identifiers) || chr(10) || case when conv_id % 11 = 0 then '--' else '---' end || chr(10) || chr(10) || case when conv_id % 11 = 0 then replace(body, chr(10) || '---' || chr(10), chr(10) || '--' || chr(10)) else body end from notes)""".replace(
        "ids(identifiers)", "case when len(identifiers) = 0 then 'identifiers: []' else 'identifiers:' || chr(10) || array_to_string(list_transform(identifiers, lambda x: '  - ' || x), chr(10)) end"
    ),
}
NEEDS = {"raw": [], "stored": ["raw"], "sources": ["stored"], "summaries": ["sources"], "notes": ["summaries"], "stories": ["sources"], "pages": ["notes", "stories"], "vectors": [], "texts": ["notes"]}


def with_views(body: str, *names: str) -> str:
    """body behind the CTEs it names; body may go on with more (", x as (...) select ...")."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS[name]:
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(CTE[n] for n in order) + "\n" + body.strip()


SLUG = "(case when trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' then 'untitled-' || sha1({0})[1:12] else trim(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')[1:120], '-') end)"
