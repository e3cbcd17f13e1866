"""The whole pipeline on the derived universe: what it must and must not find."""

from weftmark.operators import phylogeny
from weftmark.sources import lineage

SF = "/root/testdata/sf0.001"


def test_edges_of_the_derived_universe(spark):
    """The children that carry a trace of what was done to them hang below the root, the right way round; the unrelated model below nothing.

    The merge is the mean of a model and its child, so it lies on the line between them and
    looks like a step on the way: its edge to the child is the one that comes out turned.
    """
    built = phylogeny.build(lineage.tensor_rows(spark, SF), outgroups=1)
    edges = {(r["parent"], r["child"]): r["relation"] for r in built.edges.collect()}
    truth = {(p, c) for p, c, _, _ in lineage.EDGES}
    assert edges["root", "int8"] == "quantized" and edges["root", "prune30"] == "pruned"
    assert not any("unrelated" in e for e in edges)
    assert {(p, c) for p, c in edges if (c, p) in truth} <= {("merge2", "cpt")}
    judged = {(r["a"], r["b"]): r["direction"] for r in built.verdicts.collect()}
    assert judged["int8", "root"] == "b->a" and judged["prune30", "root"] == "b->a"
    assert built.nodes.count() == len(lineage.MODELS)
