"""Queries over pages: parsing, rendering, replies, names, listing and the quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.operators import pages as pg
from kbspark.operators import quality as q
from kbspark.plans import views as v
from kbspark.plans.views import SLUG, kept_once, with_views
from kbspark.session import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The page files parsed once; several checks read the table."""
    return materialise(pg.parse_pages(v.texts(spark, sf)))


@query(with_views("""select name, true as parsed_ok, title, identifiers, source, sha256(body) as body_sha256 from summaries
union all select name, conv_id % 11 <> 0, case when conv_id % 11 <> 0 then title else '' end, case when conv_id % 11 <> 0 then identifiers else [] end, '',
 case when conv_id % 11 <> 0 then sha256(body) else sha256((select text from texts where texts.name = notes.name)) end from notes""", "texts"))
@kept_once
def parse_pages(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.coalesce(pg.listed("identifiers"), F.array().cast("array<string>"))
    return pg.parse_pages(v.texts(spark, sf)).select("name", "parsed_ok", pg.scalar("title").alias("title"), ids.alias("identifiers"), pg.scalar("source").alias("source"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(with_views("select name, sha256(text) as text_sha256 from texts where name not in (select name from notes where conv_id % 11 = 0)", "texts"))
@kept_once
def render_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed pages rendered again: the same text."""
    text = pg.render(F.col("keys"), F.col("fields"), F.col("body"))
    return parsed(spark, sf).where("parsed_ok").select("name", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


@query("select doc_id, case doc_id % 3 when 0 then [coalesce(lang, '')] when 1 then [lang, source] else []::varchar[] end as items from documents")
def as_list(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    scalar = F.when(k == 0, F.coalesce("lang", F.lit(""))).when(k == 2, "")
    return table(spark, sf, "documents").select("doc_id", t.as_list(scalar, F.when(k == 1, F.array("lang", "source"))).alias("items"))


@query(with_views(f"select name, {SLUG.format('title')} as slug from summaries", "summaries"))
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return v.summaries(spark, sf).select("name", t.slugify(F.col("title")).alias("slug"))


ASCII = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '', 'g')"


@query(f"select doc_id, trim(regexp_replace(lower({ASCII}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as norm from documents")
def normalise_value(spark: SparkSession, sf: str) -> DataFrame:
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "")
    return table(spark, sf, "documents").select("doc_id", t.normalise_value(ascii_text).alias("norm"))


@query(with_views("""select name, i as identifier, split_part(i, ':', 1) as key, case when contains(i, ':') then trim(lower(i[strpos(i, ':') + 1:])) else '' end as norm
from (select name, unnest(identifiers) as i from kb_pages)""", "pages"))
def join_form(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.pages(spark, sf).select("name", F.explode("identifiers").alias("identifier"))
    return ids.withColumn("f", t.join_form(F.col("identifier"))).select("name", "identifier", "f.key", "f.norm")


REPLIES = r"""replies as (select name, conv_id, 'kind: summary' || chr(10) || 'title: ' || case when conv_id % 5 = 4 then '  ' else title end || case when conv_id % 7 = 6 then '' else chr(10) || 'identifiers:' || chr(10) || '  - ' || case when conv_id % 9 = 8 then ' ' else identifiers[1] end end as head,
  'Body of ' || name as said from notes)"""
HEADED = "'---' || chr(10) || head || chr(10) || '---' || chr(10) || chr(10) || said"
REPLY_SQL = REPLIES + f""", unwrapped as (select name, conv_id, case conv_id % 6 when 5 then rtrim('```' || chr(10) || head) else {HEADED} end as page from replies)"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply for each note: plain, fenced whole, fenced frontmatter, fence instead of dashes, and one never closed."""
    n, c = v.notes(spark, sf), F.col("conv_id")
    title = F.when(c % 5 == 4, "  ").otherwise(F.col("title"))
    ids = F.when(c % 7 == 6, "").otherwise(F.concat(F.lit("\nidentifiers:\n  - "), F.when(c % 9 == 8, " ").otherwise(F.col("identifiers")[0])))
    n = n.select("name", "conv_id", F.concat(F.lit("kind: summary\ntitle: "), title, ids).alias("head"), F.concat(F.lit("Body of "), "name").alias("said"))
    front = F.concat(F.lit("---\n"), "head", F.lit("\n---"))
    page, k = F.concat(front, F.lit("\n\n"), "said"), c % 6
    reply = (
        F.when(k == 0, page)
        .when(k == 1, F.concat(F.lit("```markdown\n"), page, F.lit("\n```\n")))
        .when(k == 2, F.concat(F.lit("```yaml\n"), front, F.lit("\n```\n\n"), "said"))
        .when(k == 3, F.concat(F.lit("```yaml\n"), "head", F.lit("\n```\n\n"), "said"))
        .when(k == 4, F.concat(F.lit("\n\n"), page, F.lit("\n")))
        .otherwise(F.concat(F.lit("```\n"), "head"))
    )
    return n.select("name", "conv_id", reply.alias("reply"))


@query(with_views(", " + REPLY_SQL + " select name, page from unwrapped", "notes"))
def unwrap_reply(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("name", pg.unwrap_reply(F.col("reply")).alias("page"))


REASON = """case when conv_id % 6 = 5 then 'unparseable: ```' when conv_id % 5 = 4 then 'blank title' when conv_id % 7 = 6 then 'identifiers missing' when conv_id % 9 = 8 then 'blank identifier' end"""


@query(with_views(f"select name, {REASON} as reason from notes", "notes"))
def reply_drop_reason(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf).select("name", pg.unwrap_reply(F.col("reply")).alias("text"))
    return pg.parse_pages(replies).select("name", pg.drop_reason().alias("reason"))


@query(with_views(", " + REPLIES + f""" select name, '---' || chr(10) || 'kind: summary' || chr(10) || 'title: ' || title || chr(10) || 'source: ' || sha256(name) || chr(10) || 'model: none' || chr(10) || 'identifiers:' || chr(10) || '  - ' || identifiers[1] || chr(10) || '---' || chr(10) || chr(10) || 'Body of ' || name as page
from notes where {REASON} is null""", "notes"))
def build_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted replies as summary pages: the job's keys first, then what the reply carried."""
    replies = materialise(_replies(spark, sf).select("name", pg.unwrap_reply(F.col("reply")).alias("text")))
    good = materialise(pg.parse_pages(replies)).where(pg.drop_reason().isNull())
    none = F.lit(None).cast("array<string>")
    own = {"kind": F.lit("summary"), "title": pg.scalar("title"), "source": F.sha2(F.col("name").cast("binary"), 256), "model": F.lit("none")}
    cli = F.map_from_arrays(F.array(*[F.lit(k) for k in own]), F.array(*[F.struct(x.alias("scalar"), none.alias("list")) for x in own.values()]))
    keys, fields = pg.build_summary(F.array(*[F.lit(k) for k in own]), cli, F.col("keys"), F.col("fields"))
    return good.select("name", pg.render(keys, fields, F.col("body")).alias("page"))


LINKS = r"links as (select name, unnest(regexp_extract_all(body, '\[\[([^\]|#]+)', 1)) as target, generate_subscripts(regexp_extract_all(body, '\[\[([^\]|#]+)', 1), 1) - 1 as pos from kb_pages where parsed_ok and kind = 'note')"


@query(with_views(", " + LINKS + " select name, pos::int as pos, trim(target) as target from links", "pages"))
def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return q.agent_pages(v.pages(spark, sf)).select("name", F.posexplode(t.wikilinks(F.col("body"))).alias("pos", "target"))


@query(with_views("select name, title, fetched from summaries", "summaries"))
@kept_once
def field_projection(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("parsed_ok").where(pg.scalar("kind") == "summary").select("name", pg.scalar("title").alias("title"), pg.scalar("fetched").alias("fetched"))


@query(with_views("select name, (title || chr(10) || array_to_string(identifiers, ', ') || chr(10) || body)[1:2000] as read from summaries", "summaries"))
def eval_text(spark: SparkSession, sf: str) -> DataFrame:
    return v.summaries(spark, sf).select("name", t.eval_text(F.col("title"), F.col("identifiers"), F.col("body")).alias("read"))


@query(with_views("select name, stem || ' | ' || title || ' | ' || trim(replace(body, chr(10), ' '))[1:200] as stub from kb_pages", "pages"))
def candidate_stub(spark: SparkSession, sf: str) -> DataFrame:
    return v.pages(spark, sf).select("name", t.candidate_stub(F.col("stem"), F.col("title"), F.col("body")).alias("stub"))


@query(with_views("select name, title from kb_pages where kind = 'note' and parsed_ok and title like 'Note %' and regexp_matches(title, '[02468]$')", "pages"))
@kept_once
def field_regex(spark: SparkSession, sf: str) -> DataFrame:
    found = parsed(spark, sf).where("parsed_ok").where(pg.scalar("title").rlike(r"^Note [0-9]*[02468]$"))
    return found.select("name", pg.scalar("title").alias("title"))


@query(with_views("""select name, kind, case when (select count(*) from kb_pages where name > 'note-2') > 200 then (select name from kb_pages where name > 'note-2' order by name limit 1 offset 199) end as next_name
from (select name, case when parsed_ok then kind end as kind from kb_pages where name > 'note-2' order by name limit 200) where kind = 'note'""", "pages"))
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = v.pages(spark, sf).select("name", F.when(F.col("parsed_ok"), F.col("kind")).alias("kind"))
    return pg.list_page(pages, after="note-2", kind="note").select("name", "kind", "next_name")


@query(with_views("select name, n from (select name, try_cast(title[6:] as int) as n from notes where conv_id % 11 <> 0) where n is not null order by n, name limit 5", "notes"))
@kept_once
def numeric_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five pages with the least number in a text field, in numeric order."""
    number = F.substring(pg.scalar("title"), 6, 20).try_cast("int")
    notes = parsed(spark, sf).where("parsed_ok").where(pg.scalar("kind") == "note").select("name", number.alias("n"))
    return notes.where("n is not null").orderBy("n", "name").limit(5)


@query(with_views("select name, len(members)::int as n_members from stories", "stories"))
def story_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return v.stories(spark, sf).select("name", F.size("members").alias("n_members")).orderBy(F.desc("n_members"), "name")


NAMED = f""", s as (select {SLUG.format('title')} as slug, source as digest, fetched from summaries where arrival % 7 <> 0), taken as (select distinct {SLUG.format('title')} as slug from summaries where arrival % 7 = 0),
n as (select s.*, row_number() over (partition by s.slug order by fetched, digest) as nth, t.slug is not null as held from s left join taken t on t.slug = s.slug)"""


def _names(spark: SparkSession, sf: str, chars: int) -> DataFrame:
    s = v.summaries(spark, sf).withColumn("slug", t.slugify(F.col("title")))
    return pg.page_names(s.where("arrival % 7 <> 0").select("slug", F.col("source").alias("digest"), "fetched"), s.where("arrival % 7 = 0"), chars, ["fetched", "digest"])


@query(with_views(NAMED + " select digest, slug || case when nth = 1 and not held then '' else '-' || digest[1:12] end || '.md' as name from n", "summaries"))
@kept_once
def summary_naming(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf, 12).select("digest", "name")


@query(with_views(NAMED + " select digest, slug || case when nth = 1 and not held then '' else '-' || digest[1:8] end || '.md' as name from n", "summaries"))
@kept_once
def story_naming(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf, 8).select("digest", "name")


@query(with_views(NAMED + " select slug, digest, nth::int as nth, nth > 1 or held as collides from n", "summaries"))
@kept_once
def slug_collision(spark: SparkSession, sf: str) -> DataFrame:
    s = v.summaries(spark, sf).withColumn("slug", t.slugify(F.col("title")))
    new = s.where("arrival % 7 <> 0").select("slug", F.col("source").alias("digest"), "fetched")
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("fetched", "digest"))
    taken = s.where("arrival % 7 = 0").select(F.col("slug").alias("held")).distinct()
    out = new.withColumn("nth", nth).join(taken, F.col("slug") == F.col("held"), "left")
    return out.select("slug", "digest", "nth", ((F.col("nth") > 1) | F.col("held").isNotNull()).alias("collides"))


@query(with_views("select source as digest, case when arrival % 2 = 0 then 'story-' || (arrival % 10) end as story, prompt_fingerprint from summaries", "summaries"))
@kept_once
def carry_story(spark: SparkSession, sf: str) -> DataFrame:
    """New summary pages keep the story that the page before them had."""
    s = v.summaries(spark, sf)
    old = s.where("arrival % 2 = 0").select(F.col("source").alias("digest"), F.concat(F.lit("story-"), F.col("arrival") % 10).alias("story"))
    return s.select(F.col("source").alias("digest"), "prompt_fingerprint").join(old, "digest", "left").select("digest", "story", "prompt_fingerprint")


# --- quality -------------------------------------------------------------------------------------

NO_EMAIL = "(values ('term', '[A-Za-z]{14,17}'))"
BOTH = "(values ('term', '[A-Za-z]{14,17}'), ('email', '[^@\\s]+@[^@\\s]+'))"
IDS = "ids as (select name, unnest(identifiers) as i, generate_subscripts(identifiers, 1) - 1 as pos from kb_pages where parsed_ok), sp as (select *, split_part(i, ':', 1) as key, i[strpos(i, ':') + 1:] as value from ids)"
STEMS = "stems as (select stem, max((kind = 'summary')::int) as by_stem from kb_pages where parsed_ok group by stem), slugs as (select distinct " + SLUG.format("title") + " as slug from kb_pages where parsed_ok and kind = 'summary')"
KNOWN = "known as (select digest from sources where arrival % 50 <> 0)"
FIND = {
    "frontmatter": "select name, 'frontmatter' as \"check\", 'frontmatter does not parse' as detail, 0 as seq from kb_pages where not parsed_ok",
    "key": f"select name, 'identifier-key' as \"check\", 'undeclared key: ' || key as detail, pos::int as seq from sp where key not in (select k from {NO_EMAIL} t(k, p))",
    "value": f"select name, 'identifier-value' as \"check\", 'bad value: ' || i as detail, pos::int as seq from sp join {BOTH} t(k, p) on k = key where value = '' or not regexp_full_match(value, p)",
    "cites": f"select name, 'cites-summary' as \"check\", 'links a summary: ' || trim(target) as detail, pos::int as seq from links left join stems on stem = trim(target) left join slugs on slug = {SLUG.format('trim(target)')} where coalesce(by_stem = 1, slug is not null)",
    "dangling": "select name, 'dangling-source' as \"check\", 'no such source: ' || source as detail, 0 as seq from kb_pages where parsed_ok and kind = 'summary' and source not in (select digest from known)",
    "member": "select name, 'story-member' as \"check\", 'no summary of: ' || m as detail, pos::int as seq from (select name, unnest(members) as m, generate_subscripts(members, 1) - 1 as pos from kb_pages where kind = 'story') where m not in (select source from kb_pages where kind = 'summary')",
    "title": f"""select a.name, 'duplicate-title' as "check", 'title shared with ' || array_to_string(list_sort(list(b.name))[1:5], ', ') || case when count(*) > 5 then ' and ' || (count(*) - 5) || ' more' else '' end as detail, 0 as seq
 from (select name, {SLUG.format('title')} as slug from kb_pages where parsed_ok and kind = 'note') a join (select name, {SLUG.format('title')} as slug from kb_pages where parsed_ok and kind = 'note') b on a.slug = b.slug and a.name <> b.name group by a.name""",
}


def _lint(*names: str) -> str:
    return with_views(", " + ", ".join([IDS, LINKS, STEMS, KNOWN]) + " " + " union all ".join(FIND[n] for n in names), "pages")


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return v.sources(spark, sf).where("arrival % 50 <> 0")


@query(_lint("frontmatter"))
@kept_once
def lint_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    return q.frontmatter(parsed(spark, sf).select("name", "parsed_ok"))


@query(_lint("key"))
def lint_identifier_key(spark: SparkSession, sf: str) -> DataFrame:
    return q.identifier_key(v.pages(spark, sf), v.vocab(spark, "email"))


@query(_lint("value"))
def lint_identifier_value(spark: SparkSession, sf: str) -> DataFrame:
    return q.identifier_value(v.pages(spark, sf), v.vocab(spark))


@query(_lint("cites"))
@kept_once
def lint_cites_summary(spark: SparkSession, sf: str) -> DataFrame:
    return q.cites_summary(v.pages(spark, sf))


@query(_lint("dangling"))
def lint_dangling_source(spark: SparkSession, sf: str) -> DataFrame:
    return q.dangling_source(v.pages(spark, sf), _known(spark, sf))


@query(_lint("member"))
@kept_once
def lint_story_member(spark: SparkSession, sf: str) -> DataFrame:
    return q.story_member(v.pages(spark, sf))


@query(_lint("title"))
@kept_once
def lint_duplicate_title(spark: SparkSession, sf: str) -> DataFrame:
    return q.duplicate_title(v.pages(spark, sf))


def _all(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with the e-mail key undeclared; the pages are scanned once."""
    return q.lint_all(v.pages(spark, sf), v.vocab(spark, "email"), _known(spark, sf))


ALL = {**FIND, "value": FIND["value"].replace(BOTH, NO_EMAIL)}
ALL_SQL = with_views(", " + ", ".join([IDS, LINKS, STEMS, KNOWN]) + ", f as (" + " union all ".join(f"select *, {i} as check_order from ({s})" for i, s in enumerate(ALL.values(), 1)) + ")", "pages")


@query(ALL_SQL + " select name, \"check\", detail, seq, check_order from f")
@kept_once
def lint_all(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).orderBy("name", "check_order", "seq")


@query(ALL_SQL + ' select "check", count(*) as findings, count(distinct name) as pages from f group by "check"')
@kept_once
def finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).groupBy("check").agg(F.count("*").alias("findings"), F.count_distinct("name").alias("pages"))


@query(ALL_SQL + ' select f.name, "check", detail, seq, check_order from f where name in (select name from notes where conv_id % 5 = 0)')
def subset_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of some pages only; the context is still the whole corpus."""
    wanted = v.notes(spark, sf).where("conv_id % 5 = 0").select("name")
    return _all(spark, sf).join(wanted, "name", "left_semi")


@query(with_views(", " + IDS + f" select name, i as identifier, value <> '' and regexp_full_match(value, '[A-Za-z]{{14,17}}') as ok from sp where key = 'term'", "pages"))
def fullmatch_value(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.pages(spark, sf).where("parsed_ok").select("name", F.explode("identifiers").alias("identifier")).where(t.key_of(F.col("identifier")) == "term")
    return ids.select("name", "identifier", q.fullmatch(t.value_of(F.col("identifier")), F.lit("[A-Za-z]{14,17}")).alias("ok"))


@query(with_views(f"select slug, count(*) as pages from (select {SLUG.format('title')} as slug from kb_pages) group by slug having count(*) > 1", "pages"))
def slug_groups(spark: SparkSession, sf: str) -> DataFrame:
    return v.pages(spark, sf).groupBy(t.slugify(F.col("title")).alias("slug")).agg(F.count("*").alias("pages")).where("pages > 1")


@query("select k.label as corpus, e.vec_id as hit, k.vec_id % 20 as query from embeddings e join embeddings k using (vec_id) where k.label || '/' || (k.vec_id % 20) not in (select label || '/' || (vec_id % 20) from embeddings where vec_id % 13 = 0)")
def valid_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a malformed hit (here each 13th name holds a slash) are refused whole."""
    e = table(spark, sf, "embeddings")
    name = F.when(F.col("vec_id") % 13 == 0, F.concat(F.lit("a/"), "vec_id", F.lit(".md"))).otherwise(F.concat(F.lit("v"), "vec_id", F.lit(".md")))
    hits = e.select(F.col("label").alias("corpus"), F.col("vec_id").alias("hit"), (F.col("vec_id") % 20).alias("query"), name.alias("name"), F.lit("t").alias("title"), F.lit(1).alias("size"))
    return q.valid_answers(hits).select("corpus", "hit", "query")


@query(with_views(f"""select source as digest, case when bad is null then 'new' else 'old' end as version, bad as reason from (select s.source, (select min(i) from (select unnest(s.identifiers) as i) where not (split_part(i, ':', 1) = 'term' and regexp_full_match(i[6:], '[A-Za-z]{{14,17}}'))) as bad from summaries s)""", "summaries"))
@kept_once
def summary_lint_drop(spark: SparkSession, sf: str) -> DataFrame:
    """A new summary page with a finding is dropped and the page before it kept; the finding is logged."""
    new = v.pages(spark, sf).where("kind = 'summary'")
    vocab = v.vocab(spark, "email")
    found = q.identifier_key(new, vocab).unionByName(q.identifier_value(new, vocab)).select("name", "seq")
    ids = new.select("name", "source", F.posexplode_outer("identifiers").alias("pos", "identifier"))
    bad = ids.join(found, (ids["name"] == found["name"]) & (ids["pos"] == found["seq"]), "left_semi").groupBy(ids["name"]).agg(F.min("identifier").alias("reason"))
    out = new.select("name", F.col("source").alias("digest")).join(bad, "name", "left")
    return out.select("digest", F.when(F.col("reason").isNull(), "new").otherwise("old").alias("version"), "reason")
