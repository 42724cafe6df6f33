import random

from fixtures import run_of, unit
from sextant.operators import tree


def model_rollup(units):
    """Recursive directory model: an area takes its first child without an error."""

    def build(items):
        children, folders = [], {}
        for parts, row in items:
            if len(parts) == 1:
                children.append((row[1], parts[0], row[0], bool(row[5]), 1, {}))
            else:
                folders.setdefault(parts[0], []).append((parts[1:], row))
        out = {}
        for name, below in folders.items():
            priority, hot, count, error, inner = build(below)
            children.append((priority, name, hot, error, count, {}))
            out[name] = (priority, hot, count, error)
            out.update({f"{name}/{k}": v for k, v in inner.items()})
        children.sort(key=lambda c: (-c[0], c[1]))
        best = next((c for c in children if not c[3]), None)
        total = sum(c[4] for c in children)
        if best is None:
            return 0.0, None, total, True, out
        return best[0], best[2], total, False, out

    priority, hot, count, error, out = build([(u[0].split("/"), u) for u in units])
    return {"": (priority, hot, count, error), **out}


def test_rollup_matches_a_recursive_model(spark):
    for seed in range(3):
        rng = random.Random(seed)
        units = []
        for n in range(40):
            folders = [rng.choice(["a", "b", "a.ts"]) for _ in range(rng.randrange(4))]
            error = "boom" if rng.random() < 0.2 else None
            priority = 0 if error else rng.choice([10, 20, 20, 30])
            units.append(unit("/".join([*folders, f"f{n}.ts"]), priority, error=error))
        got = {
            r["path"]: (r["priority"], r["hot"], r["units"], r["error"])
            for r in tree.area_rollup(run_of(spark, units)).collect()
        }
        assert got == model_rollup(units)


def test_node_table(spark):
    units = [
        unit("cli.ts", 30), unit("src/a.ts", 10), unit("src/b.ts", 80),
        unit("src/core/c.ts", 5), unit("bad/x.ts", 0, error="boom"),
    ]
    nodes = {r["path"]: r for r in tree.node_table(run_of(spark, units)).collect()}
    assert nodes["src"]["hint"] == "hottest b.ts (80.0) via criticality"
    assert (nodes["src"]["units"], nodes["src"]["priority"]) == (3, 80.0)
    assert nodes[""]["name"] == "." and nodes[""]["parent"] is None and nodes[""]["depth"] == 0
    assert (nodes["src/core/c.ts"]["depth"], nodes["src/core/c.ts"]["parent"]) == (3, "src/core")
    assert nodes["bad"]["hint"] == "no scored units" and nodes["bad"]["hot"] is None
    assert nodes["bad/x.ts"]["hint"] == "unscored: boom" and nodes["bad/x.ts"]["error"]
    assert nodes["cli.ts"]["parent"] == ""


def test_scopes_and_names(spark):
    units = [unit("src/payments/a.ts", 40), unit("src/payments/b.ts", 20), unit("cli.ts", 30)]
    nodes = tree.with_child_names(tree.node_table(run_of(spark, units)))

    def opened(path):
        rows = tree.children_of(nodes, path).orderBy(*tree.by_priority()).collect()
        return [r["path"] for r in rows]

    assert opened("src/payments") == ["src/payments/a.ts", "src/payments/b.ts"]
    assert opened("cli.ts") == ["cli.ts"]
    assert opened(None) == ["src", "cli.ts"]
    assert opened("nope") == []
    names = tree.find_node(nodes, "src/payments").first()["child_names"]
    assert names == ["a.ts", "b.ts"]


def test_rollup_combines_before_the_exchange(spark):
    df = tree.area_rollup(run_of(spark, [unit("a/b.ts", 1)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "collect" not in plan
