"""Queries over vectors: embedding texts and plans, search, multi-corpus answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.operators import vectors as vec
from kbspark.operators.vector_table import VectorTable
from kbspark.plans import source_queries
from kbspark.plans import views as v
from kbspark.plans.views import kept_once, with_views
from kbspark.session import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


READ = "case when parsed_ok then title || chr(10) || array_to_string(identifiers, chr(10)) || chr(10) || body[1:2000] else name || chr(10) || body[1:2000] end"
E = f"e as (select name, case when parsed_ok then kind else '' end as kind, case when parsed_ok then title else name end as title, {READ} as text from kb_pages), h as (select *, sha256(concat(kind, chr(0), title, chr(0), text)) as embed_hash, hash_bucket(name) as b from e)".replace("hash_bucket(name)", "('0x' || md5(name)[1:6])::bigint % 10")


@v.once
def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with what they are embedded by and its hash; b deals them to states for the examples."""
    p = v.pages.__wrapped__(spark, sf)  # this view is kept itself
    text = t.embed_text(F.col("parsed_ok"), F.col("name"), F.col("title"), F.col("identifiers"), F.lit(""), F.col("body"))
    ok = F.col("parsed_ok")
    p = p.select("name", F.when(ok, F.col("kind")).otherwise("").alias("kind"), F.when(ok, F.col("title")).otherwise(F.col("name")).alias("title"), text.alias("text"))
    b = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 6), 16, 10).cast("long") % 10
    return p.withColumn("embed_hash", t.embed_hash(F.col("kind"), F.col("title"), F.col("text"))).withColumn("b", b)


@query(with_views(", " + E + " select name, text from e", "pages"))
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return _embedded(spark, sf).select("name", "text")


@query(with_views(", " + E + " select name, embed_hash from h", "pages"))
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _embedded(spark, sf).select("name", "embed_hash")


@query("select doc_id, coalesce(source, '') || '--' || coalesce(lang, '') || '--v' || (doc_id % 3) as slug from documents")
def model_slug(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    model = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit(":v"), F.col("doc_id") % 3)
    return d.select("doc_id", t.model_slug(model).alias("slug"))


@query(with_views(", k as (select kind, string_agg(distinct split_part(i, ':', 1), chr(10) order by split_part(i, ':', 1)) as keys from (select kind, unnest(identifiers) as i from kb_pages) group by kind) select kind, sha256('rules' || chr(10) || chr(10) || 'of ' || kind || chr(10) || chr(10) || keys) as fingerprint from k", "pages"))
def prompt_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.pages(spark, sf).select("kind", F.explode("identifiers").alias("i")).select("kind", t.key_of(F.col("i")).alias("key")).distinct()
    keys = ids.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("keys"))
    return keys.select("kind", t.prompt_fingerprint(F.lit("rules"), F.concat(F.lit("of "), "kind"), F.col("keys")).alias("fingerprint"))


# Stored rows: two tenths of the pages have none, one tenth another hash, and some rows have no page.
OLD = "old as (select name, kind, title, case when b = 2 then 'stale' else embed_hash end as embed_hash from h where b > 1 union all select 'gone-' || name, kind, title, embed_hash from h where b = 5)"
PLAN = "plan as (select coalesce(h.name, o.name) as name, case when h.name is null then 'delete' when h.embed_hash is distinct from o.embed_hash then 'stale' else 'current' end as state from h full join old o on h.name = o.name)"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    h = _embedded(spark, sf)
    embedding = F.pandas_udf(vec.default_embed, "array<float>")(F.col("text"))
    kept = h.where("b > 1").select("name", "kind", "title", F.when(F.col("b") == 2, "stale").otherwise(F.col("embed_hash")).alias("embed_hash"), embedding.alias("embedding"))
    gone = h.where("b = 5").select(F.concat(F.lit("gone-"), "name").alias("name"), "kind", "title", "embed_hash", embedding.alias("embedding"))
    return kept.unionByName(gone)


@query(with_views(", " + ", ".join([E, OLD, PLAN]) + " select name, state from plan", "pages"))
@kept_once
def embed_plan(spark: SparkSession, sf: str) -> DataFrame:
    return vec.embed_plan(_embedded(spark, sf), _stored(spark, sf))


@query(with_views(", " + E + " select name, kind, title, embed_hash, 32 as dim from h", "pages"))
@kept_once
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return vec.sweep(_embedded(spark, sf), _stored(spark, sf)).select("name", "kind", "title", "embed_hash", F.size("embedding").alias("dim"))


@query(with_views(", " + E + " select name, kind, embed_hash from h", "pages"))
@kept_once
def vector_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table swept: touched buckets as a new version, then read by its manifest."""
    table = VectorTable(spark, scratch(spark))
    table.create(_stored(spark, sf))
    table.sweep(_embedded(spark, sf))
    return table.read().select("name", "kind", "embed_hash")


@query(with_views(", " + ", ".join([E, OLD, PLAN]) + """ select count(*) filter (where state = 'stale') as n_embed, count(*) filter (where state = 'delete') as n_delete,
(select count(*) from sources o left join (select source, prompt_fingerprint from summaries where arrival % 4 <> 0) s on s.source = o.digest where s.prompt_fingerprint is distinct from 'fp1') as n_summarize,
(select count(*) from summaries where source not in (select unnest(members) from stories)) as n_place from plan""", "pages"))
@kept_once
def planned_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each step would ask a model for, before it is asked: texts to embed, sources to summarise, summaries to place."""
    plan = vec.embed_plan(_embedded(spark, sf), _stored(spark, sf))
    embed = plan.agg(F.count_if(F.col("state") == "stale").alias("n_embed"), F.count_if(F.col("state") == "delete").alias("n_delete"))
    todo = source_queries.summarize_plan(spark, sf).agg(F.count("*").alias("n_summarize"))
    placed = v.stories(spark, sf).select(F.explode("members").alias("source"))
    loose = v.summaries(spark, sf).join(placed, "source", "left_anti").agg(F.count("*").alias("n_place"))
    return embed.crossJoin(todo).crossJoin(loose)  # one row each


def _behind(spark: SparkSession, sf: str) -> DataFrame:
    done = v.summaries(spark, sf).where("arrival % 4 <> 0").select(F.col("source").alias("digest"))
    return v.sources(spark, sf).select("digest").join(done, "digest", "left_anti")


@query(with_views(", " + ", ".join([E, OLD, PLAN]) + " select 'page, no vector' as state, name as what from plan where state = 'stale' union all select 'digest, no summary', digest from sources where arrival % 4 = 0", "pages"))
@kept_once
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    plan = vec.embed_plan(_embedded(spark, sf), _stored(spark, sf)).where("state = 'stale'")
    return plan.select(F.lit("page, no vector").alias("state"), F.col("name").alias("what")).unionByName(_behind(spark, sf).select(F.lit("digest, no summary").alias("state"), F.col("digest").alias("what")))


@query(with_views(", " + ", ".join([E, OLD, PLAN]) + " select case when s > 0 then 'stale vectors' else 'ok' end as status, s as stale, (select count(*) from sources where arrival % 4 = 0) as unsummarized from (select count(*) filter (where state = 'stale') as s from plan)", "pages"))
@kept_once
def search_gate(spark: SparkSession, sf: str) -> DataFrame:
    return vec.gate(_embedded(spark, sf), _stored(spark, sf), _behind(spark, sf), "default")


ASK = "q as (select name as query, kind, embedding from vectors where vec_id % 20 = 0)"
SCORED = "s as (select q.query, v.name, v.title, v.kind, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from q join vectors v on {on}), r as (select *, row_number() over (partition by query order by score desc, name) as rank from s)"


def _ask(spark: SparkSession, sf: str, kind: bool = True) -> DataFrame:
    q = v.vectors(spark, sf).where("vec_id % 20 = 0")
    return q.select(F.col("name").alias("query"), (F.col("kind") if kind else F.lit(None).cast("string")).alias("kind"), "embedding")


def _search(spark: SparkSession, sf: str, kind: bool = True, k: int = 10) -> DataFrame:
    """Nearest vectors of every 20th vector, joined to the pages that still exist (each 30th is gone)."""
    vectors = v.vectors(spark, sf)
    titles = vectors.where("vec_id % 30 <> 7").select("name", "title", "vec_id")
    return vec.search(vectors, _ask(spark, sf, kind), k).join(titles, "name")


@query(with_views(", " + ASK + ", " + SCORED.format(on="v.kind = q.kind") + " select query, name, title, round(score, 6) as score, rank::int as rank from r where rank <= 10 and vec_id % 30 <> 7", "vectors"))
def search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf).select("query", "name", "title", F.round("score", 6).alias("score"), "rank").orderBy("query", "rank")


@query(with_views(", " + ASK + ", " + SCORED.format(on="v.kind = q.kind") + " select query, name, kind from r where rank <= 5", "vectors"))
def kind_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    found = vec.search(v.vectors(spark, sf), _ask(spark, sf), 5).select("query", "name")
    return found.join(v.vectors(spark, sf).select("name", "kind"), "name").select("query", "name", "kind")


@query(with_views(", " + ASK + ", " + SCORED.format(on="true") + " select query, name, round(score, 6) as score, rank::int as rank from r where rank <= 10", "vectors"))
def topk_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return vec.search(v.vectors(spark, sf), _ask(spark, sf, False), 10).select("query", "name", F.round("score", 6).alias("score"), "rank")


@query(SQL["topk_similarity"])
def topk_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """topk_similarity over blocks that lie together, those out of reach not looked into."""
    found, _ = vec.search_clusters(vec.Clusters(v.vectors(spark, sf)), _ask(spark, sf, False), 10)
    return found.select("query", "name", F.round("score", 6).alias("score"), "rank")


NEAR = ", n as (select *, row_number() over (partition by query order by rank) as nth from r where rank <= 11 and name <> query and score >= 0.35)"


@query(with_views(", " + ASK + ", " + SCORED.format(on="v.kind = q.kind") + NEAR + " select query, name, round(score, 6) as score, nth::int as rank from n where nth <= 10", "vectors"))
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return vec.neighbours(v.vectors(spark, sf), _ask(spark, sf)).select("query", "name", F.round("score", 6).alias("score"), "rank")


@query(with_views(", " + ASK + ", " + SCORED.format(on="true") + " select query, name, round(score, 6) as score from r where rank <= 20 and score >= 0.35", "vectors"))
def similarity_floor(spark: SparkSession, sf: str) -> DataFrame:
    found = vec.search(v.vectors(spark, sf), _ask(spark, sf, False), 20)
    return found.where(F.col("score") >= vec.FLOOR).select("query", "name", F.round("score", 6).alias("score"))


@query(with_views(", " + ASK + ", " + SCORED.format(on="v.kind = q.kind") + NEAR + " select query, name, judged from n, (values (true), (false)) j(judged) where judged and nth <= 10", "vectors"))
def vector_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Vector candidates only where a judge is configured."""
    near = vec.neighbours(v.vectors(spark, sf), _ask(spark, sf)).select("query", "name")
    jobs = spark.createDataFrame([(True,), (False,)], "judged boolean")
    return near.crossJoin(F.broadcast(jobs)).where("judged")  # two settings, a fixed size


@query(with_views(", " + ASK + ", p as (select q.query, v.kind as corpus, v.name, row_number() over (partition by q.query, v.kind order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.name) as rank from q join vectors v on true where v.kind <> 'k3') select corpus, query, name, rank::int as rank from p where rank <= 3", "vectors"))
def rank_in_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _per_corpus(spark, sf).where("corpus <> 'k3'")


def _per_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest of every query in every corpus (here: each kind is one), ranked inside it."""
    vectors, ask = v.vectors(spark, sf), _ask(spark, sf, False)
    kinds = vectors.select("kind").distinct()
    # A query goes to each corpus once: queries times corpora, both stated sets.
    each = ask.drop("kind").crossJoin(F.broadcast(kinds)).select(F.concat_ws("|", "query", "kind").alias("query"), "kind", "embedding")
    found = vec.search(vectors, each, 3)
    return found.select(F.split_part("query", F.lit("|"), F.lit(2)).alias("corpus"), F.split_part("query", F.lit("|"), F.lit(1)).alias("query"), "name", "rank")


@query(with_views(", " + ASK + """, p as (select q.query, v.kind as corpus, v.name, row_number() over (partition by q.query, v.kind order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.name) as rank from q join vectors v on true),
o as (select kind as corpus, row_number() over (order by kind <> 'k5', kind <> 'k2', kind) as ordinal, case when kind = 'k3' then 'timeout' end as code from (select distinct kind from vectors))
select o.ordinal::int as ordinal, o.corpus, coalesce(o.code, 'ok') as code, p.query, p.name, p.rank::int as rank from o left join p on p.corpus = o.corpus and o.code is null and p.rank <= 3""", "vectors"))
def multi_search(spark: SparkSession, sf: str) -> DataFrame:
    """One ranked list a corpus, never merged: named corpora first, failures keep a row, no scores."""
    kinds = v.vectors(spark, sf).select(F.col("kind").alias("corpus")).distinct()
    order = Window.orderBy(F.col("corpus") != "k5", F.col("corpus") != "k2", "corpus")
    corpora = kinds.withColumn("ordinal", F.row_number().over(order)).withColumn("failed", F.when(F.col("corpus") == "k3", "timeout"))
    hits = _per_corpus(spark, sf).where("corpus <> 'k3'")
    return corpora.join(hits, "corpus", "left").select("ordinal", "corpus", F.coalesce("failed", F.lit("ok")).alias("code"), "query", "name", "rank")
