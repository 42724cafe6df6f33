"""Small runs for tree, search and tool tests."""

from sextant.operators import search, tools, tree

RUN = (
    "path string, priority double, confidence double, drivers array<string>, "
    "uncertain array<string>, error string, exports array<string>, "
    "history struct<couplings:array<struct<path:string,co_changes:bigint,strength:double>>>"
)


def unit(path, priority, couplings=(), exports=(), error=None):
    listed = [{"path": p, "co_changes": 3, "strength": s} for p, s in couplings]
    return (path, float(priority), 0.9, ["criticality"], [], error, list(exports),
            {"couplings": listed})


def run_of(spark, units):
    return spark.createDataFrame(units, RUN)


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def map_of(spark, units, edges=(), root=""):
    run = run_of(spark, units)
    nodes = tree.with_child_names(tree.node_table(run)).cache()
    relations = search.relation_table(nodes, edges_of(spark, edges), tools.coupling_rows(run))
    return search.SearchMap(nodes, relations.cache(), search.area_leaders(nodes).cache(), root)


def node(map_, path):
    return search._node_rows(map_, [path])[path]
