"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

SOURCE_STRIPES = r"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents),
words as (
    select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct r) >= 3),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v from kept group by lang),
lang_counts as (select lang, term, sum(n) as n from counts group by all),
lang_sizes as (select lang, sum(n) as n from counts group by lang),
groups as (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce(s.n, 0) as n
    from (select distinct lang, source from docs) g
    left join sizes using (lang)
    left join (select lang, source, sum(n) as n from counts group by all) s using (lang, source)),
shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
           1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p
    from groups g join kept k using (lang) left join counts c using (lang, source, term)),
lang_shares as (
    select lang, term, 1 + (1000000000::hugeint * (c.n + 1)) // (l.n + v) as q
    from lang_counts c join lang_sizes l using (lang) join sizes using (lang)),
distances as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from shares a join shares b using (lang, term) where a.source <> b.source group by all),
pairs as (
    select a.lang, a.source, b.source as item, cast(coalesce(value, 0) as bigint) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source),
terms as (
    select lang, source, term as item, cast(((p - q) * (p - q)) // q as bigint) as value
    from shares join lang_shares using (lang, term) where n > 0 and p > q),
ranked as (
    select lang, source, part, item, value,
           cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
    from (select lang, source, 'pair' as part, item, value from pairs
          union all select lang, source, 'term', item, value from terms))
select * from ranked where part = 'pair' or rank <= 200
"""

EXACT_DUPLICATES = """
with docs as (
    select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
    from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, text_sha256
from docs window same as (partition by text_sha256)
"""

MERKLE_MANIFEST = """
with recursive docs as (
    select row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as size,
           dense_rank() over (order by lang nulls first) - 1 as tree, *
    from documents),
crc as (
    select doc_id, list_reduce(list_concat([4294967295::ubigint], list_transform(
        range(1, length(cast(doc_id as varchar)) + 1), lambda i: ascii(substr(cast(doc_id as varchar), i, 1))::ubigint)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: i::ubigint)),
            lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as c
    from (select distinct doc_id from documents where doc_id is not null)),
fields as (
    select d.tree, d.pos, d.size, d.doc_id, d.n_chars,
           case when xor(crc.c, 4294967295::ubigint) % 7 = 0 then d.n_chars + 1 else d.n_chars end as claimed,
           coalesce(strlen(cast(d.doc_id as varchar)) || ':' || cast(d.doc_id as varchar), '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as before,
           coalesce(strlen(text) || ':' || text, '-') as after
    from docs d left join crc using (doc_id)),
leaves as (
    select tree, pos, size, doc_id,
           sha256(before || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') || after) as leaf,
           sha256(before || coalesce(strlen(cast(claimed as varchar)) || ':' || cast(claimed as varchar), '-') || after) as tampered
    from fields),
nodes as (
    select tree, size, 0 as level, pos, leaf as h from leaves
    union all
    select tree, max(size), level + 1, pos // 2, sha256(string_agg(h, '' order by pos))
    from nodes where size > (1::bigint << level) group by tree, level, pos // 2),
subroots as (select tree, level as height, h as subroot from nodes where size <= (1::bigint << level)),
top as (
    select count(*) over () as size, 0 as level, tree::bigint as pos, subroot as h from subroots
    union all
    select max(size), level + 1, pos // 2, sha256(string_agg(h, '' order by pos))
    from top where size > (1::bigint << level) group by level, pos // 2),
root as (select level as height, h as root from top where size <= (1::bigint << level)),
paths as (
    select l.tree, l.pos, n.level, n.pos & 1 as odd, n.h as node, s.h as sibling
    from leaves l join subroots r using (tree) join nodes n on n.tree = l.tree and n.level < r.height and n.pos = l.pos >> n.level
    left join nodes s on s.tree = n.tree and s.level = n.level and s.pos = xor(n.pos, 1)
    union all
    select l.tree, l.pos, r.height + n.level, n.pos & 1, n.h, s.h
    from leaves l join subroots r using (tree) join root o on true
    join top n on n.level < o.height and n.pos = l.tree >> n.level
    left join top s on s.level = n.level and s.pos = xor(n.pos, 1)),
proofs as (
    select tree, pos, sha256(coalesce(string_agg(sibling, '' order by level), '')) as proof_sha256 from paths group by tree, pos),
folds as (
    select tree, pos, 0 as level, tampered as h from leaves
    union all
    select f.tree, f.pos, f.level + 1, sha256(case when p.odd = 1 then coalesce(p.sibling, '') || f.h else f.h || coalesce(p.sibling, '') end)
    from folds f join paths p on p.tree = f.tree and p.pos = f.pos and p.level = f.level)
select l.doc_id, l.leaf, r.subroot, o.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root,
       f.h = o.root as verified
from leaves l join subroots r using (tree) join root o on true left join proofs p on p.tree = l.tree and p.pos = l.pos
join folds f on f.tree = l.tree and f.pos = l.pos and f.level = r.height + o.height
"""
