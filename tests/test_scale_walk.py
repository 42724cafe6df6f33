"""a step of all walks makes rows of what it takes, not of what there is to choose from."""

import itertools

from fixtures import map_of, unit

from sextant.functions.text import match_count, symbol_terms
from sextant.functions.words import locale_key
from sextant.operators import symbols, walk
from sextant.operators.search import STRATEGIES, SearchOptions

NAMES = [f"{a}/{b}/f{n}.ts" for a, b, n in itertools.product("ab", "xy", range(4))]


def made(spark):
    units = [unit(n, i % 3, exports=["loadPage" if i % 2 else "sail"]) for i, n in enumerate(NAMES)]
    return map_of(spark, units, [(NAMES[i], NAMES[(i * 7 + 3) % 16]) for i in range(16)])


def test_a_step_takes_what_is_new_in_one_row(spark):
    map_ = made(spark)
    options = SearchOptions(max_descend=3, max_symbols=2, max_related=1)
    rows = [(1, "load the page"), (2, "zz"), (3, "sails"), (3, "pages")]
    asked = walk.with_met_terms(spark.createDataFrame(rows, "objective int, intent string"), map_.nodes)
    found = walk.offers(map_, asked, options)
    at = [(1, ""), (2, ""), (3, "a"), (3, "a")]
    gone = {(1, ""): {"", "a"}, (2, ""): {""}, (3, "a"): {"", "a", "a/x"}}
    popped = spark.createDataFrame(at, "objective int, area string")
    visited = spark.createDataFrame([(o, p) for (o, _), ps in gone.items() for p in ps], "objective int, path string")
    chosen = walk.candidates(popped, visited, found, "", options)
    areas = {r["area"]: r for r in found.areas.collect()}
    named = {r["objective"]: r["symbols"] for r in found.symbols.collect()}
    caps = {"descend": 3, "symbols": 2}
    want = []
    for (objective, area), seen in gone.items():
        seen = set(seen)
        for strategy in STRATEGIES:
            listed = areas[area][strategy] if strategy != "symbols" else named.get(objective) if area == "" else None
            new = [o for o in listed or [] if o["path"] not in seen][: caps.get(strategy, 1)]
            seen |= {o["path"] for o in new}
            want += [(objective, area, o["path"], strategy, o["relation"]) for o in new]
    got = [
        tuple(r[c] for c in ("objective", "area", "path", "strategy", "relation")) for r in chosen.collect()
    ]
    assert sorted(got) == sorted(want) and {w[3] for w in want} >= {"descend", "symbols", "imports"}
    assert "Window" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_lists_have_each_path_once(spark):
    rows = [(1, "descend", 3, "p", "late"), (1, "descend", 1, "p", "early"), (1, "descend", 2, "q", "r"),
            (1, "imports", 1, "p", "i"), (2, "coupled", 1, "p", None)]
    lists = walk.in_lists(spark.createDataFrame(rows, "k int, strategy string, slot int, path string, relation string"), "k")
    got = {r["k"]: {s: [tuple(o) for o in r[s]] for s in STRATEGIES if r[s]} for r in lists.collect()}
    assert got == {1: {"descend": [("p", "early"), ("q", "r")], "imports": [("p", "i")]}, 2: {"coupled": [("p", None)]}}


def test_terms_that_match_nothing_are_left_out_of_matching(spark):
    map_ = made(spark)
    intents = [(1, "loading a page or ropes"), (2, "zz yy"), (3, None), (1, "sail loa")]
    asked = walk.with_met_terms(spark.createDataFrame(intents, "objective int, intent string"), map_.nodes)
    assert sorted(tuple(r["met"]) for r in asked.collect()) == [(), (), ("loading", "page"), ("sail",)]
    pairs = asked.crossJoin(map_.nodes.select("path", "exports"))
    tokens = symbol_terms(pairs["path"], pairs["exports"])
    assert pairs.where(match_count(pairs["terms"], tokens) != match_count(pairs["met"], tokens)).isEmpty()


def test_the_best_symbols_of_many_classes(spark):
    """Classes that cannot have one of the first units are left out before units are joined."""
    words = ["load", "page", "sail", "mast", "hull", "deck"]
    exports = [list(c) for n in (1, 2, 3) for c in itertools.combinations(words, n)] * 2
    nodes = spark.createDataFrame(
        [(f"s/f{i * 37 % 100}_{i}.ts", "n", e, "unit") for i, e in enumerate(exports)],
        "path string, name string, exports array<string>, kind string",
    )
    asked = symbols.with_terms(
        spark.createDataFrame([(1, "load page sail"), (2, "mast"), (3, "hull deck"), (4, "zz")], "objective int, intent string")
    )
    scores = {}
    for r in symbols.symbol_scores(asked, nodes).collect():
        scores.setdefault(r["objective"], []).append((-r["score"], r["path"], r["label"]))
    want = [
        (o, slot, path, label) for o, found in scores.items()
        for slot, (_, path, label) in enumerate(sorted(found, key=lambda f: (f[0], locale_key(f[1])))[:3], 1)
    ]
    got = symbols.best_symbols(asked, nodes, 3).collect()
    assert sorted((r["objective"], r["slot"], r["path"], r["label"]) for r in got) == sorted(want)
