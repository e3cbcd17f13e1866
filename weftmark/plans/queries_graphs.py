"""Queries of the graph, license and export operators over the lineage of model families."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmark.operators import export, graph, rights
from weftmark.plans.catalog import register
from weftmark.plans.queries_lineage import r6
from weftmark.plans.queries_tables import _KNOWN, _values, three_valued
from weftmark.plans.shared import dealt, materialize
from weftmark.sources import families
from weftmark.sources.families import CLOSURE, SQL, TARGET


def _facts(spark, sf_dir):
    return rights.facts(families.declared(spark, sf_dir))


@register("g02_g04_closure", f"with recursive {SQL}, {CLOSURE} select ancestor, descendant, depth from up")
def closure(spark, sf_dir):
    return graph.closure(families.edges(spark, sf_dir))


@register("g01_w11_claims", f"with recursive {SQL} select parent, child, confidence, row_number() over (partition by child order by confidence desc, parent)::int as rank from edges")
def claims(spark, sf_dir):
    return graph.best_claims(families.edges(spark, sf_dir))


@register("g05_common_ancestor", f"""
with recursive {SQL}, {CLOSURE}, u as (select ancestor, descendant, depth from up union all select node, node, 0 from (select parent as node from edges union select child from edges))
select p.a, p.b, min({{'da': u.depth, 'db': v.depth, 'n': u.ancestor}}).n as ancestor from pairs p join u on u.descendant = p.a join u v on v.descendant = p.b and v.ancestor = u.ancestor group by p.a, p.b
""")
def common(spark, sf_dir):
    """For all pairs of a family."""
    return graph.nearest_common_ancestor(families.edges(spark, sf_dir), families.family_pairs(spark, sf_dir))


_TANGLED = f"""{SQL}, e2 as materialized (select parent, child, confidence, row_number() over (order by confidence, parent, child) as k
  from (select parent, child, confidence from edges union all select parent, child, confidence from back))"""


@register("g06_break_cycles", f"""
with recursive {_TANGLED},
-- an edge goes if its child reaches its parent over edges that outrank it
w(k, node) as (select k, child from e2 union select w.k, e.child from w join e2 e on e.parent = w.node and e.k > w.k)
select parent, child, confidence from e2 where not exists (select 1 from w where w.k = e2.k and w.node = e2.parent)
""")
def break_cycles(spark, sf_dir):
    """The lineage with every fifth child pointing back at a parent."""
    e = families.edges(spark, sf_dir).select("parent", "child", "confidence")
    return graph.break_cycles(e.unionByName(families.back_edges(spark, sf_dir)))


@register("g06_break_one_cycle", f"""
with recursive {SQL}, e2 as materialized (select parent, child, confidence, row_number() over (order by confidence, parent, child) as k
  from (select parent, child, confidence from edges union all select '{TARGET}', 'part-0', 0.01::double)),
w(k, node) as (select k, child from e2 union select w.k, e.child from w join e2 e on e.parent = w.node and e.k > w.k)
select parent, child, confidence from e2 where not exists (select 1 from w where w.k = e2.k and w.node = e2.parent)
""")
def break_one_cycle(spark, sf_dir):
    """The lineage with one weak edge from a descendant of its first model."""
    e = families.edges(spark, sf_dir).select("parent", "child", "confidence")
    return graph.break_cycles(e.unionByName(spark.createDataFrame([(TARGET, "part-0", 0.01)], "parent string, child string, confidence double")))


@register("g06_strong_components", f"""
with recursive {_TANGLED}, r(a, b) as (select parent, child from e2 union select r.a, e.child from r join e2 e on e.parent = r.b)
select x.a as node, min(x.b) as component from r x join r y on y.a = x.b and y.b = x.a group by x.a
""")
def strong_components(spark, sf_dir):
    e = families.edges(spark, sf_dir).select("parent", "child", "confidence")
    return graph.strong_components(e.unionByName(families.back_edges(spark, sf_dir)))


@register("g07_topological_levels", f"with recursive {SQL}, {CLOSURE} select node, coalesce(max(w.depth), 0)::int as level from nodes left join walk w on w.descendant = node group by node")
def levels(spark, sf_dir):
    return graph.topological_levels(families.edges(spark, sf_dir), families.nodes(spark, sf_dir))


_PATHS = """wp(ancestor, descendant, path, product, low) as (
  select parent, child, [parent, child], confidence, confidence from edges union all
  select w.ancestor, e.child, w.path || [e.child], w.product * e.confidence, least(w.low, e.confidence) from wp w join edges e on e.parent = w.descendant)"""


@register("g08_transitive_reduction", f"""
with recursive {SQL}, {_PATHS}, det as (select ancestor, descendant, min({{'n': len(path), 'p': path}}).p as path from wp where len(path) > 2 group by 1, 2)
select parent, child, d.ancestor is not null as redundant, array_to_string(d.path, ' -> ') as via from edges left join det d on d.ancestor = parent and d.descendant = child
""")
def reduction(spark, sf_dir):
    kept, gone = graph.transitive_reduction(families.edges(spark, sf_dir))
    kept = kept.select("parent", "child", F.lit(False).alias("redundant"), F.lit(None).cast("string").alias("via"))
    return kept.unionByName(gone.select("parent", "child", F.lit(True).alias("redundant"), "via"))


@register("g09_roots", f"with recursive {SQL} select node from nodes anti join (select child as node from edges) using (node)")
def roots(spark, sf_dir):
    return graph.roots(families.nodes(spark, sf_dir), families.edges(spark, sf_dir))


@register("g10_weak_components", f"""
with recursive {SQL}, und as (select parent as a, child as b from edges union select child, parent from edges),
rc(node, other) as (select node, node from nodes union select rc.node, und.b from rc join und on und.a = rc.other)
select node, min(other) as component from rc group by node
""")
def weak(spark, sf_dir):
    return graph.weak_components(families.nodes(spark, sf_dir), families.edges(spark, sf_dir))


@register("g11_pair_labels", f"""
with recursive {SQL}, {CLOSURE}, sib as (select distinct x.child as a, y.child as b from edges x join edges y on x.parent = y.parent),
cou as (select distinct x.descendant as a, y.descendant as b from up x join up y on x.ancestor = y.ancestor)
select p.a, p.b, case when f.ancestor is not null then 'a->b' when r.ancestor is not null then 'b->a' when sib.a is not null then 'sibling' when cou.a is not null then 'cousin' else 'none' end as label
from pairs p left join up f on f.ancestor = p.a and f.descendant = p.b left join up r on r.ancestor = p.b and r.descendant = p.a
  left join sib on sib.a = p.a and sib.b = p.b left join cou on cou.a = p.a and cou.b = p.b
""")
def pair_labels(spark, sf_dir):
    return graph.label_pairs(families.family_pairs(spark, sf_dir), families.edges(spark, sf_dir))


@register("g12_wrong_edges", f"""
with recursive {SQL}, {CLOSURE}, cou as (select distinct x.descendant as a, y.descendant as b from up x join up y on x.ancestor = y.ancestor)
select p.parent, p.child, case when t.parent is not null then 'reversed' when f.ancestor is not null then 'ancestor-not-parent' when r.ancestor is not null then 'reversed'
  when cou.a is not null then 'cousin' else 'unrelated' end as kind
from (select * from pred anti join edges using (parent, child)) p left join (select distinct parent, child from edges) t on t.parent = p.child and t.child = p.parent
  left join up f on f.ancestor = p.parent and f.descendant = p.child left join up r on r.ancestor = p.child and r.descendant = p.parent
  left join cou on cou.a = p.parent and cou.b = p.child
""")
def wrong(spark, sf_dir):
    return graph.classify_wrong_edges(families.predicted(spark, sf_dir), families.edges(spark, sf_dir))


_AXES_SQL = """
p1 as (select distinct parent, child from pred where child not like '%0'),
wk0(a, d) as (select parent, child from pred union select w.a, e.child from wk0 w join pred e on e.parent = w.d),
wk1(a, d) as (select parent, child from p1 union select w.a, e.child from wk1 w join p1 e on e.parent = w.d),
u0 as (select a, d from wk0 where a <> d), u1 as (select a, d from wk1 where a <> d), ut as (select distinct ancestor as a, descendant as d from up),
r0 as (select node from nodes anti join (select child as node from pred) using (node)), r1 as (select node from nodes anti join (select child as node from p1) using (node)),
rt as (select node from nodes anti join (select child as node from edges) using (node)),
sc as (
  select 0 as run, 'edges' as axis, (select count(*) from (select distinct parent, child from pred) semi join edges using (parent, child)) as tp, (select count(distinct (parent, child)) from edges) as nt, (select count(distinct (parent, child)) from pred) as np
  union all select 1, 'edges', (select count(*) from p1 semi join edges using (parent, child)), (select count(distinct (parent, child)) from edges), (select count(*) from p1)
  union all select 0, 'closure', (select count(*) from u0 semi join ut using (a, d)), (select count(*) from ut), (select count(*) from u0)
  union all select 1, 'closure', (select count(*) from u1 semi join ut using (a, d)), (select count(*) from ut), (select count(*) from u1)
  union all select 0, 'roots', (select count(*) from r0 semi join rt using (node)), (select count(*) from rt), (select count(*) from r0)
  union all select 1, 'roots', (select count(*) from r1 semi join rt using (node)), (select count(*) from rt), (select count(*) from r1)),
pr as (select run, axis, tp, case when nt = 0 and np = 0 then 1 when np = 0 then 0 else tp / np end as p, case when nt = 0 and np = 0 then 1 when nt = 0 then 0 else tp / nt end as r from sc),
ax as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f from pr)
"""


@register("g13_j13_score_edges", f"""
with recursive {SQL}, {CLOSURE}, {_AXES_SQL} select tp, round(p, 6) + 0 as precision, round(r, 6) + 0 as recall, round(f, 6) + 0 as f1 from ax where run = 0 and axis = 'edges'
""")
def score_edges(spark, sf_dir):
    s = graph.set_prf(families.edges(spark, sf_dir), families.predicted(spark, sf_dir), ["parent", "child"])
    return s.select("tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def _lineages(spark, sf_dir):
    """The true edges, the predicted ones and the nodes, the lines of the parts summed once."""
    m = materialize(families.models(spark, sf_dir), "families")
    return families.edges(spark, sf_dir, m), materialize(families.predicted(spark, sf_dir, m), "families-predicted"), families.nodes(spark, sf_dir, m)


@register("g13_dag_score_axes", f"""
with recursive {SQL}, {CLOSURE}, {_AXES_SQL} select axis, tp, round(p, 6) + 0 as precision, round(r, 6) + 0 as recall, round(f, 6) + 0 as f1 from ax where run = 0
""")
def score_axes(spark, sf_dir):
    """Edges, closure and roots of a predicted lineage against the true one."""
    s = graph.score_dag(*_lineages(spark, sf_dir))
    return s.select("axis", "tp", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@register("g14_dag_delta", f"""
with recursive {SQL}, {CLOSURE}, {_AXES_SQL}
select x.axis, round(y.p - x.p, 6) + 0 as d_precision, round(y.r - x.r, 6) + 0 as d_recall, round(y.f - x.f, 6) + 0 as d_f1
from ax x join ax y on x.axis = y.axis and x.run = 0 and y.run = 1
""")
def delta(spark, sf_dir):
    t, p, n = _lineages(spark, sf_dir)
    above = graph.closure(t)
    d = graph.dag_delta(graph.score_dag(t, p, n, above), graph.score_dag(t, p.where("child not like '%0'"), n, above))
    return d.select("axis", *[r6(c).alias(c) for c in ("d_precision", "d_recall", "d_f1")])


@register("g15_validate", f"""
with recursive {SQL}, {CLOSURE}, ids as (select node from nodes union all select 'part-' || pk from fm where pk % 100 = 0),
ge as (select parent, child from edges union all select 'lost-' || pk, 'part-' || pk from fm where pk % 400 = 7),
p(a, b, direction) as (select 'part-' || pk, 'part-' || (pk + 1), ['a->b', 'b->a', 'none'][quantity % 3 + 1] from fm where place < 23 union all select 'part-' || pk, 'ghost-' || pk, 'none' from fm where pk % 300 = 1),
lb as (select p.*, case when f.ancestor is not null then 'a->b' when r.ancestor is not null then 'b->a' else 'no' end as want
  from p left join up f on f.ancestor = a and f.descendant = b left join up r on r.ancestor = b and r.descendant = a
  where a < b and a in (select node from nodes) and b in (select node from nodes))
select 'duplicate id' as problem, node as what from ids group by node having count(*) > 1
union all select 'unknown id in edges', node from (select parent as node from ge union select child from ge) anti join nodes using (node)
union all select 'unknown id in pairs', node from (select a as node from p union select b from p) anti join nodes using (node)
union all select 'label contradicts edges', a || ',' || b from lb where case when direction in ('a->b', 'b->a') then direction <> want else want in ('a->b', 'b->a') end
""")
def validate(spark, sf_dir):
    m = families.models(spark, sf_dir)
    part = lambda key: F.concat(F.lit("part-"), key.cast("string"))
    n = families.nodes(spark, sf_dir).unionAll(m.where("pk % 100 = 0").select(part(F.col("pk")).alias("node")))
    lost = m.where("pk % 400 = 7").select(F.concat(F.lit("lost-"), F.col("pk").cast("string")).alias("parent"), part(F.col("pk")).alias("child"))
    claim = F.get(F.array(F.lit("a->b"), F.lit("b->a"), F.lit("none")), (F.col("quantity") % 3).cast("int"))
    pairs = m.where("place < 23").select(part(F.col("pk")).alias("a"), part(F.col("pk") + 1).alias("b"), claim.alias("direction"))
    ghosts = m.where("pk % 300 = 1").select(part(F.col("pk")).alias("a"), F.concat(F.lit("ghost-"), F.col("pk").cast("string")).alias("b"), F.lit("none").alias("direction"))
    return graph.validate(n, families.edges(spark, sf_dir).select("parent", "child").unionAll(lost), pairs.unionAll(ghosts))


@register("w13_best_paths", f"""
with recursive {SQL}, {_PATHS}, b as (select *, row_number() over (partition by ancestor, descendant order by product desc, len(path), path) as k from wp)
select ancestor, descendant, array_to_string(path, '>') as path, round(product, 6) + 0 as product, round(low, 6) + 0 as least from b where k = 1
""")
def best_paths(spark, sf_dir):
    b = graph.best_paths(families.edges(spark, sf_dir))
    return b.select("ancestor", "descendant", F.array_join("path", ">").alias("path"), r6("product").alias("product"), r6("least").alias("least"))


@register("c29_trace", f"""
with recursive {SQL}, {CLOSURE}, k as (select ancestor as node from up where descendant = '{TARGET}' union select child from edges where parent = '{TARGET}' union select '{TARGET}')
select parent, child, confidence from edges where parent in (select node from k) and child in (select node from k)
""")
def trace(spark, sf_dir):
    return graph.trace(families.edges(spark, sf_dir), TARGET).select("parent", "child", "confidence")


_FACTS_SQL = f"kl(license, license_name, spdx, commercial_use, share_alike, attribution_required) as (values {_values(_KNOWN)}), fa as materialized (select model, coalesce(declared, 'unknown') as license, spdx, commercial_use, share_alike, attribution_required, gated from fx join kl on kl.license = coalesce(declared, 'unknown'))"


@register("r02_p28_propagate", f"""
with recursive {SQL}, {CLOSURE}, {_FACTS_SQL}, al as (select model as node, * from fa union all select up.descendant, fa.* from up join fa on fa.model = up.ancestor)
select node as model, case when bool_or(not commercial_use) then 'false' when bool_or(commercial_use is null) then 'unknown' else 'true' end as commercial_use,
  bool_or(share_alike) as share_alike, bool_or(attribution_required) as attribution_required, bool_or(gated) as gated from al group by node
""")
def propagate(spark, sf_dir):
    return rights.propagate(_facts(spark, sf_dir), families.edges(spark, sf_dir)).select("model", three_valued(), "share_alike", "attribution_required", "gated")


_CONFLICT_SQL = f"""{_PATHS}, bk as (select *, row_number() over (partition by ancestor, descendant order by product desc, len(path), path) as k from wp),
cx as (select bk.*, d.license as dl, d.commercial_use as dc, d.share_alike as ds, a.license as al, a.commercial_use as ac, a.share_alike as asa, a.gated as ag
  from bk join fa d on d.model = descendant join fa a on a.model = ancestor where k = 1),
cf2 as materialized (
  select descendant, ancestor, 'noncommercial_ancestor' as kind, case when low > 0.8 then 'high' else 'warning' end as severity, product from cx where not ac and dc
  union all select descendant, ancestor, 'share_alike_broken', case when low > 0.8 then 'high' else 'warning' end, product from cx where asa and not ds and dl <> 'unknown'
  union all select descendant, ancestor, 'unknown_ancestor', case when low > 0.8 then 'warning' else 'info' end, product from cx where al = 'unknown' or ac is null
  union all select descendant, ancestor, 'gated_ancestor', case when low > 0.8 then 'warning' else 'info' end, product from cx where ag)"""


def _conflicts(spark, sf_dir):
    return rights.conflicts(_facts(spark, sf_dir), families.edges(spark, sf_dir))


@register("r03_w12_conflicts", f"with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL} select descendant, ancestor, kind, severity, round(least(1, product), 6) + 0 as confidence from cf2")
def conflicts(spark, sf_dir):
    return rights.conflict_order(_conflicts(spark, sf_dir)).select("descendant", "ancestor", "kind", "severity", r6("confidence").alias("confidence"))


@register("r05_wording", f"""
with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL}, m as (select severity, count(*) as messages from cf2 group by severity)
select severity, messages, 0::bigint as accusing, messages as hedged from m
""")
def wording(spark, sf_dir):
    """How many messages of all conflicts accuse, and how many ask for a review."""
    return rights.wording(_conflicts(spark, sf_dir)).groupBy("severity").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.col("accusing").cast("long")).alias("accusing"), F.sum(F.col("hedged").cast("long")).alias("hedged")
    )


@register("j15_touched", f"with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL} select descendant as model from cf2 union select ancestor from cf2")
def touched(spark, sf_dir):
    return rights.touched(_conflicts(spark, sf_dir))


@register("j10_j16_outgroup_pool", f"""
with recursive {SQL}, {CLOSURE}, ways as (select a as model, b as candidate from pairs union all select b, a from pairs)
select model, candidate from ways anti join up a on a.ancestor = model and a.descendant = candidate
  anti join (select x.child as u, y.child as v from edges x join edges y on x.parent = y.parent) s on s.u = model and s.v = candidate
""")
def outgroup_pool(spark, sf_dir):
    """Models of a family that are neither descendants nor siblings of a model."""
    n, e = families.family_pairs(spark, sf_dir), families.edges(spark, sf_dir)
    way = lambda x, y: F.struct(F.col(x).alias("model"), F.col(y).alias("candidate"))
    p = n.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")
    p = dealt(p, "model", "candidate", n=families.FAMILY * spark.read.parquet(f"{sf_dir}/part.parquet").count())
    down = graph.closure(e).select(F.col("ancestor").alias("model"), F.col("descendant").alias("candidate"))
    sib = e.select("parent", F.col("child").alias("model")).join(e.select("parent", F.col("child").alias("candidate")), "parent").select("model", "candidate")
    return p.join(down, ["model", "candidate"], "left_anti").join(sib, ["model", "candidate"], "left_anti")


@register("l19_r04_bom_components", f"with recursive {SQL}, {_FACTS_SQL} select model, license, spdx, coalesce(commercial_use::varchar, 'unknown') as commercial_use, model <> '{TARGET}' as inferred from fa")
def components(spark, sf_dir):
    return export.bom_components(_facts(spark, sf_dir), TARGET).select("model", "license", "spdx", three_valued(), "inferred")


@register("l20_spdx_relationships", f"""
with recursive {SQL} select child as element, case when relation = 'merge' then 'GENERATED_FROM' else 'DESCENDANT_OF' end as type, parent as related from edges
union all select 'document', 'DESCRIBES', node from nodes anti join (select child as node from edges) using (node)
""")
def spdx_relationships(spark, sf_dir):
    return export.spdx_relationships(families.edges(spark, sf_dir), families.nodes(spark, sf_dir))


@register("l20_spdx_packages", f"""
with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL}, tx as (select descendant as m from cf2 union select ancestor from cf2)
select model, 'SPDXRef-Package-' || (row_number() over (order by model) - 1) || '-' || model as spdx_id, spdx as license_declared,
  case when license = 'unknown' or model in (select m from tx) then 'NOASSERTION' else spdx end as license_concluded from fa
""")
def spdx_packages(spark, sf_dir):
    return export.spdx_packages(_facts(spark, sf_dir), _conflicts(spark, sf_dir))


_ID = "'n_' || regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g')"


@register("l17_mermaid", f"""
with recursive {SQL}, li as (
  select 0 as s, '' as k, 'graph TD' as l union all select 1, node, '    ' || {_ID.format('node')} || '["' || node || '"]' from nodes
  union all select 2, parent || chr(9) || child, '    ' || {_ID.format('parent')} || ' -->|"' || relation || ' ' || round((confidence)::decimal(38, 17), 2)::varchar || '"| ' || {_ID.format('child')} from edges
  union all select 4, node, '    class ' || {_ID.format('node')} || ' root;' from nodes anti join (select child as node from edges) using (node))
select string_agg(l, chr(10) order by s, k, l) as text from li
""")
def mermaid(spark, sf_dir):
    return export.mermaid(families.nodes(spark, sf_dir), families.edges(spark, sf_dir))


@register("l18_dot", f"""
with recursive {SQL}, li as (
  select 0 as s, '' as k, 'digraph lineage {{' as l union all select 0, '1', '  rankdir=TB;' union all select 9, '', '}}'
  union all select 1, node, '  ' || {_ID.format('node')} || ' [label="' || node || '"];' from nodes
  union all select 2, parent || chr(9) || child, '  ' || {_ID.format('parent')} || ' -> ' || {_ID.format('child')} || ' [label="' || relation || ' ' || round((confidence)::decimal(38, 17), 2)::varchar || '", penwidth=' ||
    round((1 + 2 * least(1, confidence))::decimal(38, 17), 2)::varchar || ', style=' || case when confidence < 0.5 then 'dashed' else 'solid' end || '];' from edges)
select string_agg(l, chr(10) order by s, k, l) as text from li
""")
def dot(spark, sf_dir):
    return export.dot(families.nodes(spark, sf_dir), families.edges(spark, sf_dir))


_GRAPH_ROWS = """
select 'node' as kind, node as a, null as b, null as relation, null::double as confidence from nodes
union all select 'root', node, null, null, null from nodes anti join (select child as node from edges) using (node)
union all select 'edge', parent, child, relation, confidence from edges
"""
_EDGE_KIND = "struct<parent:string,child:string,relation:string,confidence:double>"


@register("l21_graph_json_parsed", f"with recursive {SQL} {_GRAPH_ROWS}")
def graph_json_parsed(spark, sf_dir):
    """The graph document, read back: its nodes, roots and edges."""
    lines = export.graph_json(families.nodes(spark, sf_dir), families.edges(spark, sf_dir))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("b", "string"), ("relation", "string"), ("confidence", "double"))]
    names = lambda part, kind: export.elements(lines, part, "string").select(F.lit(kind).alias("kind"), F.col("x").alias("a"), *none)
    edges = export.elements(lines, 1, _EDGE_KIND).select(F.lit("edge").alias("kind"), F.col("x.parent").alias("a"), F.col("x.child").alias("b"), "x.relation", "x.confidence")
    return names(0, "node").unionByName(names(2, "root")).unionByName(edges)


@register("l19_l21_documents")
def documents(spark, sf_dir):
    """The two documents as lines of text, in the order of part and line_no; what they hold is compared by the queries that read them back."""
    f, e, n = _facts(spark, sf_dir), families.edges(spark, sf_dir), families.nodes(spark, sf_dir)
    b = export.bom(TARGET, f, e, _conflicts(spark, sf_dir)).select(F.lit("bom").alias("kind"), "*")
    return b.unionByName(export.graph_json(n, e).select(F.lit("graph").alias("kind"), "*"))


@register("l19_bom_parsed", f"""
with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL}
select 'component' as kind, model as a, license as b, spdx as c, null::double as confidence from fa
union all select 'relationship', parent, child, relation, round(confidence, 6) + 0 from edges
union all select 'conflict', descendant, ancestor, kind || ' ' || severity, round(least(1, product), 6) + 0 from cf2
""")
def bom_parsed(spark, sf_dir):
    """The bill of materials, read back: components, relationships and conflicts."""
    lines = export.bom(TARGET, _facts(spark, sf_dir), families.edges(spark, sf_dir), _conflicts(spark, sf_dir))
    part = lambda i, kind: export.elements(lines, i, kind).select("x.*")
    c = part(0, "struct<model:string,license:string,spdx:string>").select(F.lit("component").alias("kind"), F.col("model").alias("a"), F.col("license").alias("b"), F.col("spdx").alias("c"), F.lit(None).cast("double").alias("confidence"))
    r = part(1, _EDGE_KIND).select(F.lit("relationship").alias("kind"), "parent", "child", "relation", r6("confidence"))
    w = part(2, "struct<descendant:string,ancestor:string,kind:string,severity:string,confidence:double>").select(F.lit("conflict"), "descendant", "ancestor", F.concat_ws(" ", "kind", "severity"), r6("confidence"))
    return c.unionAll(r).unionAll(w)


@register("p25_ancestor_tree", f"""
with recursive {SQL}, rk as (select *, row_number() over (partition by child order by confidence desc, parent) as i, row_number() over (partition by child order by confidence, parent desc) as j from edges),
wt(node, depth, trail, prefix, line) as (
  select '{TARGET}', 0, []::bigint[], '', '{TARGET}' union all
  select r.parent, w.depth + 1, w.trail || [r.i], w.prefix || case when j = 1 then '    ' else '|   ' end,
    w.prefix || case when j = 1 then '`-- ' else '|-- ' end || r.parent || ': ' || r.relation || ' at ' || round((r.confidence)::decimal(38, 17), 2)::varchar || case when r.weight is null then '' else ', weight ' || round((r.weight)::decimal(38, 17), 2)::varchar end
  from wt w join rk r on r.child = w.node)
select row_number() over (order by trail)::int as line_no, line from wt
""")
def tree(spark, sf_dir):
    return export.ancestor_tree(families.edges(spark, sf_dir), TARGET)


@register("p25_mixing_table", f"""
with recursive {SQL} select row_number() over (order by child, weight desc, parent)::int as line_no,
  '| `' || child || '` | `' || parent || '` | ' || round((weight)::decimal(38, 17), 3)::varchar || ' | ' || round((confidence)::decimal(38, 17), 2)::varchar || ' |' as line from edges where weight is not null
""")
def mixing_table(spark, sf_dir):
    """The rows of the report's table of recovered mixing weights."""
    return export.mixing_rows(families.edges(spark, sf_dir))


@register("p25_conflict_table", f"""
with recursive {SQL}, {_FACTS_SQL}, {_CONFLICT_SQL}
select row_number() over (order by case severity when 'high' then 0 when 'warning' then 1 else 2 end, least(1, product) desc, descendant, ancestor, kind)::int as line_no,
  '| **' || upper(severity) || '** | `' || kind || '` | ' || round((least(1, product))::decimal(38, 17), 2)::varchar || ' |' as line from cf2
""")
def conflict_table(spark, sf_dir):
    """The rows of the report's table of license warnings, without their messages."""
    rows = export.conflict_rows(_conflicts(spark, sf_dir))
    return rows.select("line_no", F.concat(F.array_join(F.slice(F.split("line", r" \| "), 1, 3), " | "), F.lit(" |")).alias("line"))
