"""Cache queries (R-6 key reuse, R-7, J-7, J-8, A-10, S-11, S-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as ca
from ..operators.batch_cache import SIMILARITY_DIGITS, resolve_in_order
from ..operators.runs import PRIMARY_MODEL
from ..operators.search import STOP_WORDS
from ..session import materialize
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query

# The reference threshold rarely fires between unrelated texts; a lower
# setting exercises the semantic tier on the same data.
LOW_THRESHOLD = 0.3
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _resolve_oracle(threshold: float) -> str:
    return f"""
, p as (select pb.*, sha256(concat_ws(':', tenant_id, '{PRIMARY_MODEL}',
                                      trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')))) as query_hash
        from prompt_batch pb)
, c as (select * exclude (r) from (
          select *, row_number() over (partition by tenant_id, query_hash order by cache_id) as r
          from cache_snapshot) where r = 1)
, exact as (select p.prompt_id, c.cache_id, 'cache_exact' as source, cast(null as double) as similarity
            from p join c using (tenant_id, query_hash))
, rest as (select * from p where prompt_id not in (select prompt_id from exact))
, ctok as (select tenant_id, cache_id, unnest(string_split_regex(lower(prompt_text), '[^\\pL\\pN_]+')) as term
           from c where has_embedding)
, cterms as (select tenant_id, cache_id, term, count(*) as tf from ctok
             where term <> '' and term not in ({_STOP}) group by all)
, cidf as (select term, ln(((select count(distinct cache_id) from cterms) + 1.0) / (count(*) + 1)) as idf
           from cterms group by term)
, cw as (select t.tenant_id, t.cache_id, t.term, t.tf * i.idf as w from cterms t join cidf i using (term))
, cvec as (select tenant_id, cache_id, term, w / n as v from cw
           join (select cache_id, sqrt(sum(w * w)) as n from cw group by 1) using (cache_id) where n > 0)
, ptok as (select tenant_id, prompt_id, unnest(string_split_regex(lower(prompt), '[^\\pL\\pN_]+')) as term
           from rest)
, pterms as (select tenant_id, prompt_id, term, count(*) as tf from ptok
             where term <> '' and term not in ({_STOP}) group by all)
, pw as (select t.tenant_id, t.prompt_id, t.term, t.tf * i.idf as w from pterms t join cidf i using (term))
, pvec as (select tenant_id, prompt_id, term, w / n as v from pw
           join (select prompt_id, sqrt(sum(w * w)) as n from pw group by 1) using (prompt_id) where n > 0)
, sims as (select pv.prompt_id, cv.cache_id, sum(pv.v * cv.v) as similarity
           from pvec pv join cvec cv on cv.term = pv.term and cv.tenant_id = pv.tenant_id
           group by all having sum(pv.v * cv.v) >= {threshold})
, sem as (select prompt_id, cache_id, 'cache_semantic' as source, similarity from (
            select *, row_number() over (partition by prompt_id order by similarity desc, cache_id) as r
            from sims) where r = 1)
, misses as (select * from rest where prompt_id not in (select prompt_id from sem))
, firsts as (select tenant_id, query_hash, arg_min(prompt_id, seq) as first_prompt_id from misses group by all)
, missed as (select m.prompt_id, cast(null as varchar) as cache_id,
                    case when m.prompt_id = f.first_prompt_id then 'miss' else 'batch_repeat' end as source,
                    cast(null as double) as similarity, f.first_prompt_id
             from misses m join firsts f using (tenant_id, query_hash))
, resolved as (select *, cast(null as varchar) as first_prompt_id from exact
               union all select *, cast(null as varchar) from sem
               union all select * from missed)
, out as (select p.prompt_id, p.tenant_id, p.query_hash, r.cache_id, r.source,
                 round(r.similarity, 6) as similarity, r.first_prompt_id, c.response_text
          from p join resolved r using (prompt_id) left join c on c.cache_id = r.cache_id)
"""


def resolved(t: Tables, threshold: float):
    return ca.resolve(fx.prompt_batch(t), fx.cache_snapshot(t), threshold)


def _out(df):
    return df.select("prompt_id", "tenant_id", "query_hash", "cache_id", "source",
                     F.round("similarity", 6).alias("similarity"), "first_prompt_id", "response_text")


_FX = ("cache_snapshot", "prompt_batch")


@query("cache_resolve", _resolve_oracle(ca.SEMANTIC_CACHE_THRESHOLD) + "select * from out", _FX)
def q_cache_resolve(t: Tables):
    """R-7 / J-7 / J-8: two-tier resolution at the reference threshold (0.75)."""
    return _out(resolved(t, ca.SEMANTIC_CACHE_THRESHOLD))


@query("cache_semantic", _resolve_oracle(LOW_THRESHOLD) + "select * from out", _FX)
def q_cache_semantic(t: Tables):
    """J-8 / A-10: the same resolution with a threshold low enough to produce semantic hits."""
    return _out(resolved(t, LOW_THRESHOLD))


@query("cache_hit_counts", _resolve_oracle(LOW_THRESHOLD) + """
select c.cache_id, c.tenant_id, c.query_hash, c.prompt_text, c.response_text, c.model_used, c.has_embedding,
       cast(c.hit_count + coalesce(h.n, 0) as bigint) as hit_count
from cache_snapshot c left join (
  select cache_id, count(*) as n from out where source in ('cache_exact', 'cache_semantic') group by 1) h
  using (cache_id)""", _FX)
def q_cache_hit_counts(t: Tables):
    """S-12: hit counters after the batch."""
    return ca.hit_counts(fx.cache_snapshot(t), resolved(t, LOW_THRESHOLD))


def new_answers(t: Tables, res):
    """Answers to store: the first prompt of each missed key, with the reply that followed
    it, and new answers (some of them NULL) for exact hits of every third conversation."""
    pb = fx.prompt_batch(t)
    a = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text"))
    asked = res.where(F.col("source").isin("miss", "cache_exact")).select("prompt_id", "query_hash", "source")
    stored = (F.col("source") == "miss") | (F.col("conv_id") % 3 == 0)
    answer = F.when(F.col("source") == "miss", F.col("response_text")) \
        .when(F.col("conv_id") % 9 != 0, F.concat(F.lit("Refreshed: "), F.col("response_text")))
    return pb.join(asked, "prompt_id").where(stored).join(a, ["conv_id", "turn"], "left").select(
        F.col("prompt_id").alias("cache_id"), "tenant_id", "query_hash", F.col("prompt").alias("prompt_text"),
        answer.alias("response_text"), F.lit(PRIMARY_MODEL).alias("model_used"), F.lit(True).alias("has_embedding"), "seq")


@query("cache_upsert", _resolve_oracle(LOW_THRESHOLD) + """
, counted as (select c.* replace (cast(c.hit_count + coalesce(h.n, 0) as bigint) as hit_count)
             from c left join (select cache_id, count(*) as n from out
                               where source in ('cache_exact', 'cache_semantic') group by 1) h using (cache_id))
, nw as (select pb.prompt_id as cache_id, pb.tenant_id, o.query_hash, pb.prompt as prompt_text,
                case when o.source = 'miss' then a.text
                     when pb.conv_id % 9 <> 0 then 'Refreshed: ' || a.text end as response_text, '""" + PRIMARY_MODEL + """' as model_used, true as has_embedding, pb.seq
         from prompt_batch pb join out o on o.prompt_id = pb.prompt_id
              and (o.source = 'miss' or o.source = 'cache_exact' and pb.conv_id % 3 = 0)
         left join conversations a on a.conv_id = pb.conv_id and a.turn = pb.turn + 1 and a.role = 'assistant')
, n as (select * exclude (r) from (
          select *, row_number() over (partition by tenant_id, query_hash order by seq desc) as r from nw)
        where r = 1)
select coalesce(o.cache_id, n.cache_id) as cache_id, coalesce(o.tenant_id, n.tenant_id) as tenant_id,
       coalesce(o.query_hash, n.query_hash) as query_hash,
       coalesce(o.prompt_text, n.prompt_text) as prompt_text,
       case when n.cache_id is not null then n.response_text else o.response_text end as response_text,
       coalesce(o.model_used, n.model_used) as model_used,
       coalesce(o.has_embedding, n.has_embedding) as has_embedding,
       case when o.cache_id is null or n.cache_id is not null then cast(0 as bigint) else o.hit_count end
         as hit_count
from counted o full outer join n on n.tenant_id = o.tenant_id and n.query_hash = o.query_hash""", _FX)
def q_cache_upsert(t: Tables):
    """S-11: the cache, hits counted, after storing this batch's answers to new and to known keys."""
    res = materialize(resolved(t, LOW_THRESHOLD), "resolved")
    return ca.upsert(ca.hit_counts(ca.dedupe_cache(fx.cache_snapshot(t)), res), new_answers(t, res))


def _in_order_oracle(threshold: float) -> str:
    """The batch prompt by prompt: a recursive query carries the list of the prompts stored so far."""
    return _resolve_oracle(threshold) + f"""
, asked as (select *, row_number() over (order by seq, prompt_id) as k from (
              select *, row_number() over (partition by tenant_id, query_hash order by seq, prompt_id) as r from rest) where r = 1)
, avec as (select a.k, a.tenant_id, v.term, v.v from asked a join pvec v using (prompt_id))
, pairs as (select x.k as x, y.k as y, sum(x.v * y.v) as similarity from avec x join avec y using (tenant_id, term)
            where x.k <> y.k group by all having sum(x.v * y.v) >= {threshold})
, prep as (select a.k, a.prompt_id in (select prompt_id from sims) as hit,
                  coalesce((select list(y) from pairs where x = a.k and y < a.k), []) as earlier from asked a)
, stored as (with recursive walk(k, entries) as (
               select cast(0 as bigint), cast([] as bigint[])
               union all
               select p.k, case when p.hit or list_has_any(w.entries, p.earlier) then w.entries else list_append(w.entries, p.k) end
               from walk w join prep p on p.k = w.k + 1)
             select unnest(entries) as k from (select entries from walk order by k desc limit 1))
, entry as (select a.k, a.prompt_id, a.tenant_id, a.query_hash, a.seq from stored join asked a using (k))
, own as (select p.prompt_id, case when p.prompt_id = e.prompt_id then 'miss' else 'cache_exact' end as source,
                 nullif(e.prompt_id, p.prompt_id) as answered_by from rest p join entry e using (tenant_id, query_hash))
, found as (select p.prompt_id, s.cache_id, cast(null as varchar) as answered_by, s.similarity, 0 as own
            from rest p join asked a using (tenant_id, query_hash) join sims s on s.prompt_id = a.prompt_id
            union all
            select p.prompt_id, null, e.prompt_id, x.similarity, 1
            from rest p join asked a using (tenant_id, query_hash) join pairs x on x.x = a.k join entry e on e.k = x.y and e.seq < p.seq)
, semantic as (select * from (select *, row_number() over (partition by prompt_id
                 order by round(similarity, {SIMILARITY_DIGITS}) desc, own, coalesce(cache_id, answered_by)) as r from found)
               where r = 1 and prompt_id not in (select prompt_id from own))
, answered as (select prompt_id, 'cache_exact' as source, cache_id, cast(null as varchar) as answered_by, cast(null as double) as similarity from exact
               union all select prompt_id, source, null, answered_by, null from own
               union all select prompt_id, 'cache_semantic', cache_id, answered_by, similarity from semantic)
select p.prompt_id, p.tenant_id, p.query_hash, r.source, r.cache_id, r.answered_by, round(r.similarity, 6) as similarity, c.response_text
from p join answered r using (prompt_id) left join c on c.cache_id = r.cache_id"""


def _in_order(t: Tables, threshold: float):
    return resolve_in_order(fx.prompt_batch(t), fx.cache_snapshot(t), threshold).select(
        "prompt_id", "tenant_id", "query_hash", "source", "cache_id", "answered_by", F.round("similarity", 6).alias("similarity"), "response_text")


@query("cache_in_order", _in_order_oracle(ca.SEMANTIC_CACHE_THRESHOLD), _FX)
def q_cache_in_order(t: Tables):
    """R-7 / J-8: the batch one prompt after another, each answer stored before the next prompt is looked up."""
    return _in_order(t, ca.SEMANTIC_CACHE_THRESHOLD)


@query("cache_in_order_low", _in_order_oracle(LOW_THRESHOLD), _FX)
def q_cache_in_order_low(t: Tables):
    """R-7 / J-8: the same with a threshold low enough for answers of the batch to be found by similarity."""
    return _in_order(t, LOW_THRESHOLD)
