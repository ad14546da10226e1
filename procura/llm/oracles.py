"""DuckDB SQL for the queries that SQL can express, on whole tables.

op3 (XXH64 fingerprints), op5 (a greedy plan) and op7 (CRC-32) have none; they are
tested against brute force."""

from __future__ import annotations

from . import licenses, mixing, quality
from .licenses import NOTICES, SHORT_NOTICES

W = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    bins, unit = quality.BINS, f"{quality.UNIT}.0"
    names = list(bins)
    unpivot = " union all ".join(f"select good, '{n}' feature, {n} bin from marked" for n in names)
    total = " + ".join(f"coalesce((select r from ratio where feature = '{n}' and bin = d.{n}), "
                       f"(select r from unseen where feature = '{n}'))" for n in names)
    sizes = ", ".join("('{}', {}, {}, {})".format(n, b, *quality.spread(n)) for n, b in bins.items())
    buckets, half = quality.GRAM_BUCKETS, bins["grams"] // 2
    no_points = quality.NO_PUNCTUATION.replace("'", "''")
    edge, most = quality.EDGE, quality.MOST_SHRUNK

    def weight(v: str, groups: str) -> str:
        spread = f"({v} / greatest(1, n) - mean * (1 - mean) * {groups} / greatest(1, n))"
        return f"case when {spread} <= 0 then {most} else least({most}, greatest(1.0, mean * (1 - mean) / {spread} - 1.0)) end"

    return rf"""
with words as (select row_number() over () id, doc_id, source, lang, coalesce(text, '') body,
    string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') tokens,
    regexp_replace(coalesce(text, ''), '{quality.PLAIN}', '', 'g') marks from documents),
codes as (select id, doc_id, list_transform(regexp_extract_all(body, '(?s).'), lambda c: unicode(c)::bigint) c from words),
grams as (select id, doc_id, unnest(list_transform(range(1, len(c) - 1),
    lambda i: ((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) % {buckets})) bucket from codes where len(c) > 2),
learnt as (select doc_id, quality from labels where quality in (0, 1) and doc_id is not null
    order by md5(doc_id::varchar), doc_id, quality limit {quality.GRAM_LABELS}),
shown as (select bucket, count(*) filter (where quality = 1) g, count(*) filter (where quality = 0) b
    from grams join learnt using (doc_id) group by bucket),
shown_all as (select coalesce(sum(g), 0) tg, coalesce(sum(b), 0) tb from shown),
weights as (select bucket, floor((ln((coalesce(g, 0) + 1.0) / (tg + {buckets})) - ln((coalesce(b, 0) + 1.0) / (tb + {buckets})))
    * {quality.GRAM_UNIT} + 0.5)::bigint w from (select unnest(range({buckets})) bucket) left join shown using (bucket), shown_all),
means as (select id, least({bins['grams'] - 1}, greatest(0, {half} + floor(sum(w) * {quality.GRAM_STEPS} / ({quality.GRAM_UNIT} * count(*)))))::int grams
    from grams join weights using (bucket) group by id),
counts as (select words.*, coalesce(grams, {half}) grams, len(tokens) n,
    length(regexp_replace(marks, '{quality.NO_CAPITAL}', '', 'g')) n_capitals,
    length(regexp_replace(marks, '{no_points}', '', 'g')) n_points,
    len(list_filter(range(2, len(tokens) + 1), lambda i: tokens[i] = tokens[i - 1])) n_repeats
    from words left join means using (id)),
bins as (select doc_id, source, lang, grams,
    least({bins['symbols'] - 1}, floor((length(marks) - n_capitals - n_points) * 8 / greatest(n, 1)))::int symbols,
    least({bins['punctuation'] - 1}, floor(n_points * 4 / (n + 3)))::int punctuation,
    least({bins['capitals'] - 1}, floor(n_capitals * 16 / greatest(length(body), 1)))::int capitals,
    least({bins['repeats'] - 1}, floor(n_repeats * 16 / greatest(n, 1)))::int repeats,
    least({bins['size'] - 1}, length(bin(n + 1)) - 1)::int size from counts),
marked as (select b.*, l.quality good from bins b join labels l on b.doc_id = l.doc_id where l.quality in (0, 1)),
classes as (select count(*) filter (where good = 1) g, count(*) filter (where good = 0) b from marked),
long as ({unpivot}),
sizes(feature, k, more, less) as (values {sizes}),
ratio as (select feature, bin, ln((count(*) filter (where good = 1) + any_value(more)) / (any_value(g) + any_value(k * more)))
    - ln((count(*) filter (where good = 0) + any_value(less)) / (any_value(b) + any_value(k * less))) r
    from long join sizes using (feature), classes group by feature, bin),
unseen as (select feature, ln(more / (g + k * more)) - ln(less / (b + k * less)) r from sizes, classes),
base as (select ln(((g + 1.0) / (g + b + 2.0)) / (1 - (g + 1.0) / (g + b + 2.0))) lb from classes),
seen as (select d.*, {total} evidence from bins d),
own as (select *, round({unit} / (1 + exp(-(evidence + lb))))::bigint own from seen, base),
paths as (select source, lang, count(*) pn, sum(own)::double ps from own group by all),
hosts as (select source, sum(pn) hn, sum(ps) hs from paths group by all),
totals as (select sum(pn)::double n, sum(ps) / {unit} / sum(pn) mean0, count(*) groups from paths),
level0 as (select *, least(1 - {edge}, greatest({edge}, mean0)) mean from totals),
level1 as (select any_value(n) n, any_value(mean) mean, any_value(groups) groups,
    sum(hn * pow(hs / {unit} / hn - mean, 2)) v, count(*) hosts from hosts, level0),
weight1 as (select *, {weight('v', 'hosts')} hw from level1),
rates as (select source, (hs / {unit} + hw * mean) / (hn + hw) host_rate from hosts, weight1),
level2 as (select any_value(n) n, any_value(mean) mean, any_value(groups) groups,
    sum(pn * pow(ps / {unit} / pn - host_rate, 2)) v
    from paths p join rates r on p.source is not distinct from r.source, weight1),
weight2 as (select *, {weight('v', 'groups')} pw from level2),
priors as (select o.doc_id, o.evidence, r.host_rate, least(1 - {edge}, greatest({edge},
    ((ps - own) / {unit} + pw * host_rate) / (pn - 1 + pw))) site_prior
    from own o join paths p on o.source is not distinct from p.source and o.lang is not distinct from p.lang
    join rates r on o.source is not distinct from r.source, weight2),
judged as (select *, 1 / (1 + exp(-(evidence + ln(site_prior / (1 - site_prior))))) q from priors)
select doc_id, round(evidence, 6) evidence, round(host_rate, 6) host_rate, round(site_prior, 6) site_prior,
    round(q, 6) quality, q >= {quality.THRESHOLD} keep from judged"""


OP2 = f"""
with t as (select doc_id, {LOWER} norm from documents),
g as (select norm, max(doc_id) keep_id, count(*) group_size from t group by norm),
r as (select t.*, keep_id, group_size, row_number() over (partition by norm, doc_id) rn from t join g using (norm))
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id and rn = 1 kept, sha256(norm) text_sha256 from r"""

OP4 = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
rules(action, h, pre) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit as (select page_id, host, path, h || pre rule, action,
    row_number() over (partition by host, path order by length(h || pre) desc, action desc, h || pre) rn
    from (select distinct host, path, min(page_id) page_id from p group by host, path) x
    join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre))
select p.page_id, p.host, p.path, rule, coalesce(action, 'allow') verdict
from p left join (select * from hit where rn = 1) w on p.host = w.host and p.path = w.path"""

OP6 = f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {W}))::bigint size from documents),
weights as (select source, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight
    from (select distinct source from sized)),
keyed as (select *, coalesce('s' || source, 't') skey,
    md5('{mixing.SEED}|' || coalesce(doc_id::varchar, '')) seeded from sized),
par as (select greatest(1, least({mixing.MAX_SHARDS}, ceil(sum(size) / {mixing.WORDS_PER_SHARD}.0)))::bigint shards,
    floor(sum(size) / {mixing.BLOCK}.0 + 0.5)::bigint blocks, sum(size)::double total from keyed),
placed as (select keyed.*, ('0x' || substr(seeded, 25, 8))::bigint % {mixing.MAX_SHARDS} * shards // {mixing.MAX_SHARDS} shard from keyed, par),
cells as (select skey, shard, sum(size)::bigint cell from placed group by all),
sources as (select skey, sum(cell)::bigint source_size, count(*) filter (where cell > 0) n_cells, any_value(weight) weight
    from cells join weights w on skey = coalesce('s' || w.source, 't') group by skey),
levels as (select *, source_size * {mixing.MAX_REPEATS}.0::double cap,
    (total - coalesce(sum(source_size * {mixing.MAX_REPEATS}.0::double) over before, 0)) /
    (sum(weight) over () - coalesce(sum(weight) over before, 0)) level from sources, par
    window before as (order by source_size * {mixing.MAX_REPEATS}.0::double / weight, skey
        rows between unbounded preceding and 1 preceding)),
targets as (select *, least(cap, max(level) over () * weight) target, count(*) over () n_sources from levels),
s1 as (select skey, target / {mixing.BLOCK} share, blocks seats,
    (1 + ceil(2.0 * (target / {mixing.BLOCK}) * n_sources / greatest(blocks, 1)))::bigint slack from targets where target > 0),
s2 as (select *, greatest(0, floor(share)::bigint - slack) given, floor(share)::bigint + slack upto from s1),
s3 as (select *, seats - sum(given) over () open, unnest(range(given + 1, upto + 1)) k from s2),
s4 as (select *, row_number() over (order by share / (2 * k - 1) desc, skey, k) <= open won from s3),
seats as (select skey, max(given) + count(*) filter (where won) source_quota from s4 group by skey),
c0 as (select c.*, source_size, n_cells, target, coalesce(source_quota, 0) source_quota
    from cells c join targets using (skey) left join seats using (skey)),
c1 as (select *, source_quota * cell / source_size share from c0 where source_size > 0),
c2 as (select *, (1 + ceil(2.0 * share * n_cells / greatest(source_quota, 1)))::bigint slack from c1 where share > 0),
c3 as (select *, greatest(0, floor(share)::bigint - slack) given, floor(share)::bigint + slack upto from c2),
c4 as (select *, source_quota - sum(given) over (partition by skey) open, unnest(range(given + 1, upto + 1)) k from c3),
c5 as (select *, row_number() over (partition by skey order by share / (2 * k - 1) desc, shard, k) <= open won from c4),
quotas as (select skey, shard, max(given) + count(*) filter (where won) quota from c5 group by all),
won as (select c0.*, least(coalesce(quota, 0) * {mixing.BLOCK}, cell * {mixing.MAX_REPEATS})::bigint won
    from c0 left join quotas using (skey, shard)),
rooms as (select *, cell * {mixing.MAX_REPEATS} - won room, sum(room) over (partition by skey) all_room,
    sum(room) over (partition by skey order by shard rows unbounded preceding) upto,
    least(source_quota * {mixing.BLOCK} - sum(won) over (partition by skey), all_room) beyond from won),
plan as (select *, (won + beyond * upto // greatest(all_room, 1) - beyond * (upto - room) // greatest(all_room, 1))::bigint take from rooms),
ring as (select p.*, sum(size) over (partition by skey, shard order by seeded, doc_id nulls first, size
    rows unbounded preceding)::bigint stop from placed p),
parts as (select r.doc_id, r.size, source_size, target, stop, take, case when cell > 0 then take // cell else 0 end again, cell
    from ring r join plan using (skey, shard))
select doc_id, size, source_size, target,
    (again * size + greatest(0, least(stop, take - again * cell) - (stop - size)))::bigint taken from parts"""

OP8 = rf"""
with docs as (select row_number() over () row, doc_id, regexp_extract_all(coalesce(text, ''), {W}) w from documents),
windows as (select row, doc_id, unnest(range(1, len(w) - 11)) pos, w from docs where len(w) >= 13),
keyed as (select row, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') win from windows),
firsts as (select win, min(doc_id) source from keyed group by win having min(doc_id) < max(doc_id) or
    (count(*) filter (where doc_id is null) > 0 and min(doc_id) is not null)),
gone as (select distinct row, unnest(range(pos, pos + 13)) pos from keyed join firsts using (win)
    where source < doc_id or (doc_id is null and source is not null)),
removed as (select row, list(pos) gone from gone group by row)
select doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) kept_sha256
from docs left join removed using (row)"""

OP9 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
    where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint score
    from (select distinct vec_id, q from v where vec_id % 50 = 0) a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5"""


def _op10() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in (*NOTICES, *SHORT_NOTICES))
    term = r"'[\p{L}\p{N}]+'"
    return rf"""
with n(license, template) as (values {rows}),
nt as (select *, regexp_extract_all(lower(template), {term}) t from n),
kt as (select *, least({licenses.SHINGLE_WORDS}, len(t)) k from nt),
want as (select license, template, k,
    list_distinct(list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' '))) s from kt),
wanted as (select license, template, k, len(s)::int n_shingles, unnest(s) shingle from want),
docs as (select row_number() over () row, doc_id, regexp_extract_all(lower(coalesce(text, '')), {term}) t from documents),
flat as (select row, doc_id, k, unnest(range(0, len(t) - k + 1)) pos, t from docs, (select distinct k from kt) where len(t) >= k),
have as (select row, doc_id, k, pos, array_to_string(t[pos + 1:pos + k], ' ') shingle from flat)
select doc_id, license, template, n_shingles, count(distinct shingle)::int n_found,
    count(distinct shingle) / n_shingles::double containment, min(pos)::int first_term
from have join wanted using (k, shingle) group by row, doc_id, license, template, n_shingles
having count(distinct shingle) >= n_shingles * {licenses.CONTAINMENT} - 1e-9"""


def _escaped(column: str) -> str:
    """The column with its control strings broken: backslashes doubled, then one set into each control string."""
    doubled = rf"replace({column}, '\', '\\')"
    return rf"regexp_replace(regexp_replace({doubled}, '<(/?s>)', '<\\\1', 'g'), '\[(/?(INST|ROLE)\])', '[\\\1', 'g')"


OP13 = rf"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role rank_role, text rank_text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, length({_escaped('text')}) + length('<s></s>') + case role when 'user' then length('[INST]  [/INST]')
    when 'assistant' then 0 else length('[ROLE]  [/ROLE] ') + length({_escaped('role')}) end size from said)
select conv_id, count(*) n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, rank_role nulls first, rank_text nulls first)) turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, rank_text nulls first) filter (where role = 'assistant'), '')) loss_sha256,
    sum(size)::bigint formatted_chars
from sized group by conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality": _op1(),
    "op2_exact_dedup": OP2,
    "op4_url_filter": OP4,
    "op6_mixing": OP6,
    "op8_substring_dedup": OP8,
    "op9_topk_search": OP9,
    "op10_licenses": _op10(),
    "op13_chat": OP13,
}
