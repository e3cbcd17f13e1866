"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"

OP1 = rf"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""

OP4 = """
with d as (
  select doc_id, strlen(coalesce(text, ''))::bigint as doc_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents
),
levels as (select d.*, x.level, h >> (60 - x.level) as prefix from d, range(0, 41) x(level)),
sizes as (
  select doc_id, doc_bytes, h, level, sum(doc_bytes) over w as shard_bytes, count(*) over w as shard_docs
  from levels window w as (partition by level, prefix)
),
leaf as (
  select doc_id, doc_bytes, h, min(level) as depth from sizes
  where shard_bytes <= 8388608 or shard_docs = 1 group by all
)
select doc_id, doc_bytes,
       case when depth = 0 then '' else substr(lpad(bin(h), 60, '0'), 1, depth::int) end as shard,
       depth::int as depth, shard_bytes::bigint as shard_bytes, shard_docs
from leaf join sizes using (doc_id, doc_bytes, h) where sizes.level = leaf.depth
"""

OP5 = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'),
           lambda x: x <> '') as w
  from documents
),
s as materialized (
  select doc_id, list_distinct(case
           when len(w) = 0 then []
           when len(w) < 5 then [md5(array_to_string(w, ' '))]
           else list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) end) as s
  from w
),
sets as materialized (select min(doc_id) as c, s, len(s) as n from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s),
tok as materialized (select c, n, unnest(s) as t from sets),
common as (select t from tok group by t having count(*) > 1),
shared as materialized (select c, n, t from tok semi join common using (t)),
links as materialized (
  select a.c as a, b.c as b from shared a join shared b on a.t = b.t and a.c < b.c
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
pairs as materialized (select a, b from links union select b, a from links),
reach(c, r) as (select c, c from sets union select reach.c, pairs.b from reach join pairs on pairs.a = reach.r),
comp as (select c, min(r) as component_id from reach group by c),
of as (select s.doc_id, len(s.s) as n_shingles, sets.c from s left join sets on list_sort(s.s) = sets.s)
select doc_id, n_shingles, coalesce(comp.component_id, doc_id) as component_id from of left join comp using (c)
"""

OP6 = rf"""
with w as materialized (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') as w from documents
),
win as materialized (
  select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)
),
flagged as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as f from win) where doc_id > f),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from flagged),
lists as (select doc_id, list(p) as ps from gone group by doc_id),
words as (
  select w.doc_id, w.w, coalesce(ps, []) as ps from w left join lists using (doc_id)
),
places as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from w),
kept as (
  select doc_id, string_agg(x, ' ' order by p) as t from places anti join gone using (doc_id, p) group by doc_id
)
select words.doc_id, len(w)::bigint as n_words, len(ps)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
"""

OP7 = rf"""
with d as (
  select doc_id, source as src,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''))::bigint as size
  from documents
),
s as (select src, sum(size)::bigint as source_size from d group by src),
w as (
  select *, case (row_number() over (order by src nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
         2.0::double * source_size as cap
  from s
),
l as (
  select *, cap / w as level, row_number() over (order by cap / w, src nulls last) as o from w
),
f as (
  select *, (1.5::double * sum(source_size::double) over () - coalesce(sum(cap) over (order by o rows between unbounded preceding and 1 preceding), 0))
            / (sum(w) over () - coalesce(sum(w) over (order by o rows between unbounded preceding and 1 preceding), 0)) as share
  from l
),
t as (
  select src, source_size, least(cap, coalesce(w * (select min_by(share, o) from f where share < level), cap)) as target from f
),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0 end as ratio,
         row_number() over (partition by d.src order by d.size, d.doc_id nulls last)::double as rank,
         ('0x' || substr(md5('17:' || coalesce(d.src, '')), 1, 8))::bigint::double / 4294967296.0::double as u
  from d join t on d.src is not distinct from t.src
)
select doc_id, size, source_size, target,
       (floor(rank * ratio + u) - floor((rank - 1) * ratio + u))::bigint * size as taken
from r
"""

OP8 = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') as lines
  from documents
),
win as (
  select doc_id, i, count(*) over (partition by doc_id, a) as n
  from (select doc_id, i, array_to_string(w[i:i + 2], ' ') as a from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d))
),
rep as (select doc_id, count(*) as n_repeat_words from
  (select distinct doc_id, unnest(range(i, i + 3)) as p from win where n > 1) group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::bigint as n_letters,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint as n_upper
  from d left join rep using (doc_id)
),
x as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
    + 8 * (n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines)::bigint + 16 * (2 * word_chars < 5 * n_words)::bigint
    + 32 * (word_chars > 15 * n_words)::bigint + 64 * (n_letters > 0 and 2 * n_upper > n_letters)::bigint
    + 128 * (2 * n_letters < word_chars)::bigint as failed_mask
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_mask & 3) <> 0 as base_failed, (failed_mask & 127) = 0 as kept, failed_mask::bigint as failed_mask
from x
"""

_MEASURED = OP8[: OP8.rindex("select doc_id, n_words, word_chars")]

ABLATIONS = _MEASURED + """, rules(rule, bit) as (values ('too_few_words', 1), ('repeated_words', 2), ('symbol_share', 4), ('duplicate_lines', 8),
  ('short_words', 16), ('long_words', 32), ('shouting', 64))
select rule, (count(*) filter (where failed_mask & bit <> 0))::bigint as n_failed, (count(*) filter (where failed_mask & 127 = bit))::bigint as n_failed_alone,
       (count(*) filter (where failed_mask & (127 - bit) = 0))::bigint as n_kept_without
from x, rules group by rule
"""

HELD_OUT = """
select doc_id, xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda r, b: list_reduce([xor(r, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 5 = 0 as held_out
from documents
"""

LICENSE_PLACES = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
           lambda x: x <> '') as w
  from documents
),
p(phrase, n, label) as (values ('gnu general public license', 4, 'gpl'), ('apache license', 2, 'apache'), ('cc by', 2, 'cc-by'), ('mit license', 2, 'mit')),
b as (
  select doc_id, i - 1 as place, label from (select doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] in ('gnu', 'apache', 'cc', 'mit'))) as i from d)
  join p on array_to_string(w[i:i + n - 1], ' ') = phrase
),
s as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join s using (doc_id)
"""

PII_BASE = r"""
with p(kind, place) as (values ('email', 1), ('ip', 2), ('card', 3), ('phone', 4)),
d as (select doc_id, coalesce(text, '') as t from documents),
x as (
  select doc_id, 1 as place, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as g from d
  union all select doc_id, 2, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') from d
  union all select doc_id, 3, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') from d
  union all select doc_id, 4, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') from d
),
s as (
  select doc_id, place, m[i] as s, regexp_replace(m[i], '[^0-9]', '', 'g') as digits,
         list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as a
  from (select *, unnest(range(1, len(m) + 1)) as i from x)
),
v as (
  select doc_id, kind, s.place, a::bigint as a, (a + length(s))::bigint as e from s join p using (place)
  where case s.place when 1 then true
    when 2 then list_max(list_transform(string_split(s, '.'), lambda z: case when length(ltrim(z, '0')) > 3 then 999 else ('0' || ltrim(z, '0'))::int end)) <= 255
    when 3 then length(digits) between 13 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda j:
      case when j % 2 = 1 then digits[length(digits) - j + 1]::int else (2 * digits[length(digits) - j + 1]::int) // 10 + (2 * digits[length(digits) - j + 1]::int) % 10 end)) % 10 = 0
    else length(digits) between 9 and 15 end
),
c as (
  select doc_id, count(*) filter (where place = 1) as n_email, count(*) filter (where place = 2) as n_ip, count(*) filter (where place = 3) as n_card,
         count(*) filter (where place = 4) as n_phone, string_agg(kind || ':' || a || ':' || e, ',' order by place, a) as spans
  from v group by doc_id
)
select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card,
       coalesce(n_phone, 0)::bigint as n_phone, sha256(coalesce(spans, '')) as base_sha256
from d left join c using (doc_id)
"""

SQL = {
    "op1_exact_dedup": OP1,
    "op4_sharding": OP4,
    "op5_jaccard_join": OP5,
    "op6_substring_dedup": OP6,
    "op7_mixing": OP7,
    "op8_quality_rules": OP8,
    "quality_ablations": ABLATIONS,
    "language_held_out": HELD_OUT,
    "license_base_places": LICENSE_PLACES,
    "pii_base_spans": PII_BASE,
}
