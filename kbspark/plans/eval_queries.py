"""Queries over evaluation sets, and the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.operators import evaluate as ev
from kbspark.operators import vectors as vec
from kbspark.plans import views as v
from kbspark.plans.views import with_views
from kbspark.session import configure, materialise, scratch, table
from kbspark.streaming import limits
from kbspark.streaming.ingest import Tables, ingest_all

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ASK = "q as (select name as query, kind, embedding from vectors where vec_id % 20 = 0)"
RANKED = ASK + ", s as (select q.query, v.name, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score, v.kind = q.kind as relevant, v.vec_id % 3 = 0 as short_stub from q join vectors v on v.name <> q.query), r as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s)"


def _scores(spark: SparkSession, sf: str, k: int = 1 << 30) -> DataFrame:
    """Scores for every 20th vector, itself left out: those of all vectors, or at least of the k nearest and ties."""
    vectors = v.vectors(spark, sf)
    ask = vectors.where("vec_id % 20 = 0").select(F.col("name").alias("query"), F.lit(None).cast("string").alias("kind"), "embedding")
    found = vec.nearest(vectors, ask, k + 1).where(F.col("name") != F.col("query"))
    kinds = vectors.select("name", "kind", "vec_id")
    own = kinds.select(F.col("name").alias("query"), F.col("kind").alias("query_kind"))
    out = found.join(kinds, "name").join(own, "query")
    return out.select("query", "name", F.col("vec_id").alias("pos"), "score", (F.col("kind") == F.col("query_kind")).alias("relevant"), (F.col("vec_id") % 3 == 0).alias("short_stub"))


METRICS = """m as (select query, count(*) filter (where relevant) as n, count(*) filter (where relevant and rank <= 5) as a5, count(*) filter (where relevant and rank <= 10) as a10, min(rank) filter (where relevant) as first, count(*) filter (where rank <= 10 and score < 0.5) as under,
 sum(rank) filter (where relevant and short_stub) as ss, count(*) filter (where relevant and short_stub) as sn, sum(rank) filter (where relevant and not short_stub) as ls, count(*) filter (where relevant and not short_stub) as ln from r group by query)"""


@query(with_views(", " + RANKED + ", " + METRICS + " select count(*) as queries, round(avg(a5 / n), 9) as recall_at_5, round(avg(a10 / n), 9) as recall_at_10, round(avg(1 / first), 9) as mrr, sum(under)::bigint as under_cutoff, round(sum(ss) / sum(sn), 9) as mean_rank_short, round(sum(ls) / sum(ln), 9) as mean_rank_long from m where n > 0", "vectors"))
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.retrieval_metrics(_evaluated(v.vectors(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) if c not in ("queries", "under_cutoff") else F.col(c) for c in out.columns])


def _evaluated(vectors: DataFrame) -> DataFrame:
    """What retrieval is judged by, for every 20th vector as a query."""
    vectors = vectors.withColumn("pos", F.col("vec_id")).withColumn("short_stub", F.col("vec_id") % 3 == 0)
    return vec.relevant_counts(vectors, vectors.where("vec_id % 20 = 0").select(F.col("name").alias("query"), "kind", "embedding"))


# Each model sees its own dimensions of the vectors; a run's cost and time go by its pages.
MODELS = [("full", "local", 1, 64), ("front", "hosted", 1, 32), ("back", "hosted", 33, 32)]
MODEL_SQL = " union all ".join(
    f"select '{m}' as model, '{kind}' as kind, {n} as dims, q.query, v.vec_id, list_cosine_similarity(q.embedding[{at}:{at + n - 1}]::double[], v.embedding[{at}:{at + n - 1}]::double[]) as score, v.kind = q.kind as relevant from q join vectors v on v.name <> q.query"
    for m, kind, at, n in MODELS
)


@query(with_views(", " + ASK + ", s as (" + MODEL_SQL + """), r as (select *, row_number() over (partition by model, query order by score desc, vec_id) as rank from s),
m as (select model, query, count(*) filter (where relevant) as n, count(*) filter (where relevant and rank <= 5) as a5, count(*) filter (where relevant and rank <= 10) as a10, min(rank) filter (where relevant) as first from r group by model, query),
t as (select model, round(avg(a5 / n), 9) as recall_at_5, round(avg(a10 / n), 9) as recall_at_10, round(avg(1 / first), 9) as mrr, count(*) as queries from m where n > 0 group by model),
u as (select model, kind, dims, (select count(*) from vectors) as pages from (values ('full', 'local', 64), ('front', 'hosted', 32), ('back', 'hosted', 32), ('none', 'hosted', 0)) w(model, kind, dims))
select u.model, u.kind, u.dims, u.dims * 4 as bytes_per_page, coalesce(recall_at_5, 0.0) as recall_at_5, coalesce(recall_at_10, 0.0) as recall_at_10, coalesce(mrr, 0.0) as mrr, coalesce(queries, 0) as queries,
 case when u.kind = 'hosted' then round(u.dims * pages * 0.000001 / pages * 1000, 4) end as cost_per_1k, round((10 + pages * 0.002) / pages * 1000, 4) as wall_per_1k, case when u.kind = 'hosted' then 'wall time network-bound' else '-' end as notes
from u left join t using (model)""", "vectors"))
def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Models by recall, with dimensions, bytes, cost and wall time; one that was never asked has zeros."""
    vectors, metrics = v.vectors(spark, sf), None
    for model, _, at, n in MODELS:
        found = ev.retrieval_metrics(_evaluated(vectors.withColumn("embedding", F.slice("embedding", at, n)))).withColumn("model", F.lit(model))
        metrics = found if metrics is None else metrics.unionByName(found)
    runs = spark.createDataFrame([(m, kind, n) for m, kind, _, n in MODELS] + [("none", "hosted", 0)], "model string, kind string, dims int")
    pages = vectors.agg(F.count("*").alias("pages"))  # one row
    runs = runs.crossJoin(pages).withColumn("cost_usd", F.col("dims") * F.col("pages") * 0.000001).withColumn("wall_seconds", 10 + F.col("pages") * 0.002)
    return ev.model_table(metrics, runs)


LABELS = "l as (select conv_id as q, list_sort(list(distinct role)) as hand, list_sort(list(distinct case when turn % 2 = 0 then role else 'r' || (turn % 3) end)) as judge from conversations group by conv_id)"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two label sets of each conversation: its roles, and roles of even turns with turn labels of odd ones."""
    c = configure(spark) and table(spark, sf, "conversations")
    judged = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.concat(F.lit("r"), F.col("turn") % 3))
    return c.groupBy(F.col("conv_id").alias("q")).agg(F.array_sort(F.collect_set("role")).alias("hand"), F.array_sort(F.collect_set(judged)).alias("judge"))


AGREE = LABELS + ", a as (select q, case when len(hand) = 0 and len(judge) = 0 then 1.0 else len(list_intersect(hand, judge)) / len(list_distinct(list_concat(hand, judge))) end as j, list_sort(list_filter(hand, lambda x: not list_contains(judge, x))) as hand_only, list_sort(list_filter(judge, lambda x: not list_contains(hand, x))) as judge_only from l)"


@query("with " + AGREE + " select q, round(j, 4) as jaccard, j = 1 as exact, len(hand_only)::int as n_hand, len(judge_only)::int as n_judge from a")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return ev.label_agreement(_labels(spark, sf)).select("q", "jaccard", "exact", F.size("hand_only").alias("n_hand"), F.size("judge_only").alias("n_judge"))


@query("with " + AGREE + " select q, hand_only, judge_only from a")
def label_except(spark: SparkSession, sf: str) -> DataFrame:
    return ev.label_agreement(_labels(spark, sf)).select("q", "hand_only", "judge_only")


@query(with_views(", " + ASK + """, p as (select a.kind = b.kind as same, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from q a join vectors b on a.query <> b.name)
select same, count(*) as pairs, round(quantile_cont(score, 0.5), 6) as p50, round(quantile_cont(score, 0.9), 6) as p90, round(quantile_cont(score, 0.99), 6) as p99, round(max(score), 6) as most from p group by same""", "vectors"))
def similarity_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of every 20th vector with all others, within and across kinds.

    Scores are counted at six digits where the blocks meet, so the last step sees two million
    values at most, however many pairs there are.
    """
    vectors = v.vectors(spark, sf)
    counted = vec.score_counts(vectors, vectors.where("vec_id % 20 = 0").select(F.col("name").alias("query"), "kind", "embedding"))
    cuts = F.percentile("score", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("n"))
    out = counted.groupBy("same").agg(F.sum("n").alias("pairs"), cuts.alias("cuts"), F.max("score").alias("most"))
    return out.select("same", "pairs", *[F.round(F.col("cuts")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))], F.round("most", 6).alias("most"))


@query(with_views(", " + RANKED + " select relevant, count(*) as hits, round(min(score), 6) as least, round(quantile_cont(score, 0.5), 6) as median, round(max(score), 6) as most, count(*) filter (where score >= 0.1) as kept from r where rank <= 10 group by relevant", "vectors"))
def band_profile(spark: SparkSession, sf: str) -> DataFrame:
    top = ev.rankings(_scores(spark, sf, 10)).where("rank <= 10")
    out = top.groupBy("relevant").agg(F.count("*").alias("hits"), F.min("score").alias("least"), F.percentile("score", 0.5).alias("median"), F.max("score").alias("most"), F.count_if(F.col("score") >= 0.1).alias("kept"))
    return out.select("relevant", "hits", *[F.round(c, 6).alias(c) for c in ("least", "median", "most")], "kept")


MANIFEST = "man as (select stem as slug, substr(source, 1, 1) as domain, arrival, (row_number() over (partition by substr(source, 1, 1) order by arrival) - 1) % 3 = 0 as short_stub from summaries)"


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    domain = F.substring("source", 1, 1)
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("arrival"))
    m = v.summaries(spark, sf).select(F.col("stem").alias("slug"), domain.alias("domain"), "arrival")
    return m.withColumn("short_stub", (nth - 1) % 3 == 0)


@query(with_views(", " + MANIFEST + " select slug, domain, short_stub from man", "summaries"))
def short_stub_split(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("slug", "domain", "short_stub")


@query(with_views(", " + MANIFEST + " select m.slug, m.short_stub, s.title, length(s.body) as body_chars from man m join summaries s on s.stem = m.slug", "summaries"))
def eval_load(spark: SparkSession, sf: str) -> DataFrame:
    pages = v.summaries(spark, sf).select(F.col("stem").alias("slug"), "title", F.length("body").cast("long").alias("body_chars"))
    return _manifest(spark, sf).join(pages, "slug").select("slug", "short_stub", "title", "body_chars")


# --- streams -------------------------------------------------------------------------------------


def _ingested(spark: SparkSession, sf: str) -> Tables:
    """documents as a file stream through all steps: stored, summarised, embedded, placed."""
    schema = table(spark, sf, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    return ingest_all(spark, v.raw_of(docs))


@query(with_views("select arrival, digest, job, status from stored", "stored"))
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of all batches of the stream."""
    return _ingested(spark, sf).read("results").select("arrival", "digest", "job", "status")


INGESTED = r""", k as (select *, coalesce(lower(trim(split_part(content_type, ';', 1))), 'text/plain') as m from sources),
ro as (select *, case when m = 'image/png' then 'attachment' when m = 'application/pdf' then 'actionable: pdf disabled' when strlen(data) > 1000000 then 'actionable: too large' else 'text' end as route, trim(regexp_replace(data, '[ \t\r\n]+', ' ', 'g')) as flat from k),
rt as (select *, trim(regexp_replace(flat[1:40], '[^A-Za-z0-9 .,]', '', 'g')) as title, list_transform(list_sort(list_distinct(regexp_extract_all(data, '[A-Za-z]{14,17}'))), lambda w: 'term:' || w) as ids, array_to_string(string_split(flat, '. ')[1:2], '. ') as lead from ro),
good as (select *, SLUG as slug from rt where route = 'text' and title <> ''),
named as (select *, slug || case when row_number() over (partition by slug order by fetched, digest) > 1 then '-' || digest[1:12] else '' end || '.md' as name from good)"""


@query(with_views(INGESTED.replace("SLUG", v.SLUG.format("title")).replace("\\\\", "\\") + """ select 'page' as what, name as id, digest || chr(10) || title || chr(10) || array_to_string(ids, ',') as detail from named
union all select 'vector', name, sha256('summary' || chr(0) || title || chr(0) || title || chr(10) || array_to_string(ids, chr(10)) || chr(10) || lead[1:2000]) from named
union all select 'dropped', digest, case when route <> 'text' then route else 'blank title' end from rt where route <> 'text' or title = ''""", "sources"))
def ingest_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, vectors and drops that the stream left."""
    out = _ingested(spark, sf)
    page = F.concat_ws("\n", "digest", "title", F.array_join("identifiers", ",")).alias("detail")
    rows = out.read("pages").select(F.lit("page").alias("what"), F.col("name").alias("id"), page)
    rows = rows.unionByName(out.read("vectors").select(F.lit("vector").alias("what"), F.col("name").alias("id"), F.col("embed_hash").alias("detail")))
    return rows.unionByName(out.read("dropped").select(F.lit("dropped").alias("what"), F.col("digest").alias("id"), F.col("reason").alias("detail")))


@query(None)
def ingest_stories(spark: SparkSession, sf: str) -> DataFrame:
    """Stories that the stream left; tests hold them against one run over all sources."""
    return _ingested(spark, sf).stories()


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = configure(spark) and table(spark, sf, "events")
    return e.select(F.col("user_id").cast("long").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("id")).withColumn("ts", F.col("us") / 1e6)


def _streamed(spark: SparkSession, sf: str, kind: type) -> DataFrame:
    """The log as a stream of eight batches, each call up to an hour late: dealt out by a moved time."""
    path = scratch(spark)
    log = materialise(_log(spark, sf).select("client", F.col("us").cast("long").alias("us"), "id"))
    span = log.agg(F.min("us").alias("low"), F.max("us").alias("high"))
    late = F.col("us") + F.pmod(F.xxhash64("id"), F.lit(3_600_000_000))
    dealt = log.crossJoin(F.broadcast(span)).withColumn("batch", F.floor(8 * (late - F.col("low")) / (F.col("high") - F.col("low") + 3_600_000_001)))
    parts = scratch(spark)
    dealt.select("client", "us", "id", "batch").write.partitionBy("batch").parquet(parts)
    dealt = spark.read.schema("client long, us long, id long, batch long").parquet(parts)
    for batch in range(8):
        dealt.where(F.col("batch") == batch).drop("batch").coalesce(1).write.parquet(f"{path}/{batch}")
    return limits.limit_files(spark, path, kind, 3, 86400.0, "61 minutes").select("client", (F.col("us") / 1e6).alias("ts"), "id", "admitted", "retry_after")


CALLS = "with recursive e as (select user_id as client, epoch_us(ts) / 1e6::double as ts, event_id as id, row_number() over (partition by user_id order by ts, event_id) as n from events)"


FIXED = CALLS + """, f as (
 select *, ts as started, 1 as held, true as admitted, 0::bigint as retry_after from e where n = 1
 union all
 select e.*, case when e.ts - started >= 86400 then e.ts else started end, case when e.ts - started >= 86400 then 1 else least(held + 1, 3) end, held < 3 or e.ts - started >= 86400,
  case when held < 3 or e.ts - started >= 86400 then 0 else greatest(1, ceil(86400 - (e.ts - started)))::bigint end
 from f join e on e.client is not distinct from f.client and e.n = f.n + 1)
select client, ts, id, admitted, retry_after from f"""


@query(FIXED)
def fixed_window_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Three calls a day and user, the day starting at the first."""
    return limits.limit_log(_log(spark, sf), limits.FixedWindow, 3, 86400.0)


SLIDING = CALLS + """, f as (
 select *, [ts] as times, true as admitted, 0::bigint as retry_after from e where n = 1
 union all
 select client, ts, id, n, case when len(live) < 3 then list_append(live, ts) else live end, len(live) < 3, case when len(live) < 3 then 0 else greatest(1, ceil(86400 - (ts - live[1])))::bigint end
 from (select e.*, list_filter(times, lambda x: e.ts - x < 86400) as live from f join e on e.client is not distinct from f.client and e.n = f.n + 1))
select client, ts, id, admitted, retry_after from f"""


@query(SLIDING)
def sliding_window_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Three admitted calls in any 24 hours and user."""
    return limits.limit_log(_log(spark, sf), limits.SlidingWindow, 3, 86400.0)


@query(FIXED)
def fixed_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    """fixed_window_limit as a stream whose calls come late: the same decisions."""
    return _streamed(spark, sf, limits.FixedWindow)


@query(SLIDING)
def sliding_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, limits.SlidingWindow)
