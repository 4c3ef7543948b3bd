"""DuckDB SQL with the results of the corpus queries."""

from __future__ import annotations

OP3 = r"""
with sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case l.quality when 1 then 2.0 when 0 then 0.5 else 1.0 end::double as w
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id
), keyed as (
  select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) / w as k from sized
), sources as (
  select source, sum(size)::bigint as source_size from keyed group by source
), ranked as (
  select *, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight, row_number() over (order by source asc nulls last) as rank from sources
), reached as (
  select *, 3 * source_size / weight as reach from ranked
), filled as (
  select *, coalesce(sum(3 * source_size) over before, 0)::bigint as full_words, sum(weight) over () - coalesce(sum(weight) over before, 0.0::double) as open_weight, (sum(source_size) over ())::bigint as total
  from reached window before as (order by reach, rank rows between unbounded preceding and 1 preceding)
), levels as (
  select *, (total * 1.0::double - full_words) / open_weight as level from filled
), targets as (
  select source, source_size, least(3.0::double * source_size, weight * coalesce((select arg_min(level, (reach, rank)) from levels where level <= reach), 'inf'::double)) as target from levels
), summed as (
  select k.doc_id, k.size, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
         sum(k.size) over (partition by k.source order by k.k, k.doc_id, k.size rows between unbounded preceding and current row) as upto
  from keyed k join targets t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (case when size > 0 then least(epochs + case when upto - size / 2.0::double < target - epochs * source_size then 1 else 0 end, 3) else 0 end * size)::bigint as taken
from summed
"""

OP8 = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) as body from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words)),
firsts as (select body, min(doc_id) as first_doc from starts group by body),
hits as (select s.doc_id, s.i from starts s join firsts f using (body) where f.first_doc < s.doc_id),
gone as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 50)) as j from hits)),
kept as (
  select w.doc_id, len(w.w)::bigint as n_words, coalesce(g.js, []) as js, w.w
  from words w left join (select doc_id, list(j) as js from gone group by doc_id) g on w.doc_id = g.doc_id
), placed as (
  select k.doc_id, u.i, k.w[u.i] as word from kept k, (select doc_id, unnest(range(1, len(w) + 1)) as i from words) u
  where u.doc_id = k.doc_id and not exists (select 1 from gone g where g.doc_id = u.doc_id and g.j = u.i)
), joined as (select doc_id, string_agg(word, ' ' order by i) as text from placed group by doc_id)
select k.doc_id, k.n_words, len(k.js)::bigint as n_removed, sha256(coalesce(j.text, '')) as kept_sha256
from kept k left join joined j on k.doc_id = j.doc_id
"""

OP5 = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
runs as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from worded)),
often as (select doc_id, i from (select *, count(*) over (partition by doc_id, run) as n from runs) where n > 1),
repeated as (select doc_id, count(distinct j)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from often) group by doc_id),
lines as (select doc_id, line, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw
          from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from docs)),
real_lines as (select *, row_number() over (partition by doc_id, line order by line_no) as nth, len(array_to_string(lw, ''))::bigint as chars,
                      rtrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || '"''”’»)]') as body from lines where len(lw) > 0),
faults as (
  select *, case
    when len(regexp_extract_all(line, '[|»›•·→]')) > 0.2::double * len(lw) then 'navigation'
    when regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|use of cookies|enable javascript|lorem ipsum|click here|sign up now|subscribe to our newsletter|powered by|skip to content') then 'boilerplate'
    when not regexp_matches(body, '[.!?:;…。！？]$') or len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.3::double * len(lw) or len(regexp_extract_all(line, '!!')) > 0.5::double * len(lw) then 'punctuation'
    else '' end as fault
  from real_lines),
by_doc as (
  select doc_id, count(*) filter (nth > 1)::bigint as n_dup_lines, count(*) filter (fault = 'punctuation')::bigint as n_punctuation, count(*) filter (fault = 'navigation')::bigint as n_navigation,
         count(*) filter (fault = 'boilerplate')::bigint as n_boilerplate, coalesce(sum(chars) filter (fault <> ''), 0)::bigint as lost_chars
  from faults group by doc_id),
counted as (
  select w.doc_id, len(w.w)::bigint as n_words, len(array_to_string(w.w, ''))::bigint as word_chars, len(regexp_extract_all(w.text, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(b.n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(b.n_punctuation, 0) as n_punctuation, coalesce(b.n_navigation, 0) as n_navigation,
         coalesce(b.n_boilerplate, 0) as n_boilerplate, coalesce(b.lost_chars, 0) as lost_chars
  from worded w left join by_doc b on w.doc_id = b.doc_id left join repeated r on w.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= 0.5::double * word_chars as kept, n_punctuation, n_navigation, n_boilerplate, lost_chars
from counted
"""

OP1 = r"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
  select vec_id as n, vec_id as m from embeddings union select r.n, l.b from reach r join links l on r.m = l.a
)
select e.vec_id, coalesce(l.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join (select a, count(*) as n from links group by a) l on e.vec_id = l.a join (select n, min(m) as component_id from reach group by n) c on c.n = e.vec_id
"""

URL_RULES = r"""
with p as (
  select page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages
), r as (
  select *, case
    when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
    when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/'
    when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
    when ('.' || host) like '%.org' and path like '/%' then 'org/' end as rule from p
)
select *, case rule when 'org/' then 'allow' when 'com/fr/' then 'allow' else case when rule is not null then 'block' end end as listed from r
"""


def _op11(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """Lloyd's rounds one after the other, by plain comparison of all vectors with all centroids."""
    parts = [f"""
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), parts as materialized (select row, unnest(range(1, {dim + 1})) as d, unnest(e) as x from v
), c0 as materialized (
  select c, unnest(range(1, {dim + 1})) as d, unnest(e) as x
  from (select e, row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), e) - 1 as c from v qualify c < {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""
, a{r} as materialized (
  select row, arg_min(c, (distance, c)) as c, min(distance) as distance
  from (select p.row, c.c, sum((p.x - c.x) * (p.x - c.x))::bigint as distance from parts p join c{r} c on p.d = c.d group by p.row, c.c) group by row
)""")
        if r < rounds:
            parts.append(f"""
, c{r + 1} as materialized (
  select o.c, o.d, coalesce(n.x, o.x) as x from c{r} o left join (
    select c, d, ((s - ((s % n) + n) % n) // n)::bigint as x from (select a.c, p.d, sum(p.x)::bigint as s, count(*)::bigint as n from parts p join a{r} a on p.row = a.row group by a.c, p.d)
  ) n on o.c = n.c and o.d = n.d
)""")
    return "".join(parts) + f"""
select v.vec_id, a.c::integer as cluster, a.distance, (sum(a.distance) over (partition by a.c))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia, s.centroid_sha256
from v join a{rounds} a on v.row = a.row join (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by c) s on a.c = s.c
"""


def _grown(tree: str, levels: int = 8) -> str:
    """Levels of a tree whose leaves are {tree}0 (g, i, n, h), and with {tree}s0 (row, g, i, n, f, p) the folding of each row's leaf and its siblings so far."""
    parts = []
    for k in range(levels):
        parts.append(f"""
, {tree}{k + 1} as materialized (
  select g, i // 8 as i, max((n + 7) // 8) as n, sha256(string_agg(h, '' order by i)) as h from {tree}{k} where n > 1 group by g, i // 8
  union all select g, i, n, h from {tree}{k} where n = 1
), {tree}s{k + 1} as materialized (
  select s.row, s.g, s.i // 8 as i, (s.n + 7) // 8 as n, sha256(string_agg(case when t.i = s.i then s.f else t.h end, '' order by t.i)) as f,
         s.p || coalesce(string_agg(t.h, '' order by t.i) filter (t.i <> s.i), '') as p
  from {tree}s{k} s join {tree}{k} t on s.g = t.g and s.i // 8 = t.i // 8 where s.n > 1 group by s.row, s.g, s.i, s.n, s.f, s.p
  union all select * from {tree}s{k} where n = 1
)""")
    return "".join(parts)


def _field(x: str) -> str:
    return f"case when {x} is null then '-' else strlen({x}::varchar)::varchar || ':' || {x}::varchar end"


#: CRC-32 of a list of byte values.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: xor(a >> 1, 3988292384::bigint * (a & 1)))), 4294967295::bigint)"""

_LEAF = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "{text}"))

OP13 = f"""
with d as materialized (
  select row_number() over () as row, doc_id, coalesce('=' || lang, '') as g, sha256({_LEAF.format(text="text")}) as leaf,
         sha256({_LEAF.format(text="(case when coalesce(" + _CRC + " % 3 = 0, false) then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end)")}) as now
  from documents
), placed as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf, row) - 1 as i, count(*) over (partition by g) as n from d
), a0 as materialized (select g, i, n, leaf as h from placed
), as0 as materialized (select row, g, i, n, now as f, '' as p from placed
){_grown("a")}
, b0 as materialized (select 0 as g, row_number() over (order by g) - 1 as i, count(*) over () as n, h, g as name from a8
), bs0 as materialized (select s.row, b.g, b.i, b.n, s.f, s.p from as8 s join b0 b on s.g = b.name
){_grown("b", 3)}
select d.doc_id, d.leaf, t.h as subroot, r.h as root, sha256(s.p) as proof_sha256, s.f as folded_root, s.f = r.h as verified
from d join bs3 s on d.row = s.row join b0 t on d.g = t.name cross join b3 r
"""

ORACLES = {"op11_delta_lloyd": _op11(), "op13_merkle": OP13, "op1_lattice": OP1, "url_rules": URL_RULES, "op3_mixing": OP3, "op5_line_rules": OP5, "op8_seed_extend": OP8}
