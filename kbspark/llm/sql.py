"""DuckDB SQL with the same rows as the queries that SQL can express."""

OP2 = r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), bad as (
  select key, max(doc_id) as stay from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), m as (
  select k.*, bad.key is not null and k.doc_id <> bad.stay as gone from k left join bad using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r, doc_id
"""

OP4 = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       coalesce(doc_id = max(doc_id) over g, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window g as (partition by coalesce(text, ''))
"""

OP9 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s
), r as (
  select *, source_size * 3.0::double / w as ratio, sum(source_size) over () as total, sum(w) over () as weight from w
), l as (
  select *, (total - coalesce(sum(source_size) over b, 0) * 3.0::double) / (weight - coalesce(sum(w) over b, 0)) as level
  from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
), o as (
  select max(level) as level from l where ratio > level
), t as (
  select l.source, source_size, coalesce(least(source_size * 3.0::double, o.level * w), source_size * 3.0::double) as target from l, o
), q as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from t
), c as (
  select doc_id, size, source_size, target, q.source, rate, k,
         floor(rate) + (('0x' || md5('mix-1|' || k || '|' || coalesce(doc_id::varchar, ''))[1:13])::bigint / 4503599627370496.0::double < rate - floor(rate))::int as copies
  from d join q on d.source is not distinct from q.source cross join (select unnest(range(1, 33)) as k)
), b as (
  select source, k from c group by source, target, k qualify row_number() over (partition by source order by abs(sum(copies * size) - target), k) = 1
)
select doc_id, size::bigint as size, source_size, target, c.source, copies::bigint as copies, (copies * size)::bigint as taken
from c join b on c.source is not distinct from b.source and c.k = b.k
"""

OP11 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify rank <= 5
"""

OP12 = r"""
with recursive d as materialized (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as materialized (
  select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                                 else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as shingle from d
), n as materialized (
  select r, count(*) as n from s group by r
), c as (
  select a.r as a, b.r as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.r <> b.r group by all
), l as materialized (
  select a, b from c join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)
), t(a, b) as (
  select a, b from l union select t.a, l.b from t join l on t.b = l.a
), m as (
  select t.a as r, min(d.doc_id) as least from t join d on d.r = t.b group by t.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(d.doc_id, m.least), d.doc_id) as component_id,
       d.doc_id = coalesce(least(d.doc_id, m.least), d.doc_id) as kept
from d left join n using (r) left join m using (r)
"""

SQL = {"op12_minmax_dedup": OP12, "op11_hard_negatives": OP11, "op2_line_dedup": OP2, "op4_exact_dedup": OP4, "op9_mix_sources": OP9}
