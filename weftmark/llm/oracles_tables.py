"""DuckDB SQL of the operators on vectors, conversations and lines."""

from __future__ import annotations


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Rounds of the k-means written out, every distance measured."""
    nearest = """
a{i} as materialized (
  select r, min({{'d': d, 'c': c}}) as best
  from (select v.r, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, m{i} m)
  group by r
)"""
    moved = """
s{i} as materialized (
  select c, j, sum(y)::bigint as s, count(*)::bigint as n
  from (select a.best.c as c, unnest(v.x) as y, generate_subscripts(v.x, 1) as j from a{i} a join v using (r)) group by c, j
),
m{n} as materialized (
  select m.c, coalesce(f.x, m.x) as x
  from m{i} m left join (select c, list((s - ((s % n) + n) % n) // n order by j) as x from s{i} group by c) f using (c)
)"""
    parts = [
        f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x
  from embeddings
  where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
m0 as materialized (
  select (row_number() over (order by sha256('{seed}:' || vec_id::varchar) nulls last, x) - 1)::int as c, x from v
  qualify row_number() over (order by sha256('{seed}:' || vec_id::varchar) nulls last, x) <= {k}
)"""
    ]
    for i in range(rounds):
        parts += [nearest.format(i=i), moved.format(i=i, n=i + 1)]
    parts.append(nearest.format(i=rounds))
    return ",".join(parts) + f"""
select vec_id, best.c as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia,
       (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
from a{rounds} a join v using (r) join m{rounds} m on m.c = a.best.c
"""


_CRC = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint),
    lambda r, b: list_reduce([xor(r, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"""

TRIE = f"""
with t as (
  select conv_id as c, turn, strlen(coalesce(text, ''))::bigint as bytes,
         sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as g
  from conversations where conv_id is not null
),
seqs as materialized (select c, list(g order by turn nulls first, g) as g, list(bytes order by turn nulls first, g) as b from t group by c),
heads as (select c, g, b, c - c % 5 as base, {_CRC} % 9 as h from seqs),
built as materialized (
  select x.c, coalesce(y.g[1:x.h], []) || x.g[x.h + 1:] as g, coalesce(y.b[1:x.h], []) || x.b[x.h + 1:] as b
  from heads x left join seqs y on y.c = x.base
),
steps as (select c, g, b, unnest(range(0, len(g) + 1)) as d from built),
prefixes as materialized (
  select c, d, sha256(array_to_string(g[1:d], ',')) as p, case when d = 0 then 0 else b[d] end as bytes, len(g) = d as ends,
         case when d = 0 then null else sha256(array_to_string(g[1:d - 1], ',')) end as up
  from steps
),
nodes as materialized (
  select d, p, any_value(up) as up, min(c) as c, count(*) as n, any_value(bytes) as bytes,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256
  from prefixes group by d, p
),
kids as materialized (select d - 1 as d, up as p, count(*) as n_children from nodes where d > 0 group by all),
marked as materialized (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (d, p)),
-- a node counts at every prefix of its smallest conversation
rolled as (
  select a.d, a.p, count(*) filter (where m.n_children = 0) as n_leaves, sum((m.n - 1) * m.bytes) as saved_tokens
  from marked m join prefixes a on a.c = m.c and a.d <= m.d group by a.d, a.p
)
select m.c as conv_id, m.d::bigint as depth, u.c as parent_conv_id, m.n as n_convs, m.n_children, n_leaves, saved_tokens::bigint as saved_tokens, m.ends_sha256
from marked m join rolled using (d, p) left join marked u on u.d = m.d - 1 and u.p = m.up
"""

LINES = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents
),
k as materialized (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
),
common as (select key, true as gone from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where gone is null), '')) as kept_sha256
from k left join common using (key) group by doc_id
"""

SQL = {"op11_centroids": centroid_sql(), "op12_conversation_trie": TRIE, "op13_line_dedup": LINES}
