"""Walks of many objectives against one walk at a time, and symbol look-up against word lists."""

import itertools
import random

import pytest
from fixtures import edges_of, map_of, run_of, unit

from sextant.functions.words import _pair, locale_key, matched, query_words, symbol_words, words
from sextant.judge import LexicalJudge
from sextant.operators import search, symbols, tools, tree, walk
from sextant.operators.search import SearchOptions

WORDS = ["anchor", "anchors", "rope", "hull", "winch", "barrel", "cold", "store", "plank", "sail", "mast", "deck"]


def made_map(spark, seed, root=""):
    rng = random.Random(seed)
    names = [
        f"{a}/{b}/{rng.choice(WORDS)}{n}.ts" for a, b, n in itertools.product(["hull", "dock", "yard"], ["east", "west"], range(5))
    ] + [f"dock/{w}.ts" for w in WORDS[:4]] + ["top.ts"]
    units = [
        unit(n, rng.choice([10, 20, 30, 40]), exports=[rng.choice(WORDS).title() + rng.choice(WORDS).title()],
             couplings=[(rng.choice(names), rng.choice([0.5, 0.75]))] if rng.random() < 0.4 else ())
        for n in names
    ]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(60)}
    return map_of(spark, units, [(s, d) for s, d in edges if s != d], root), names


@pytest.mark.parametrize(
    "options",
    [
        SearchOptions(budget=5),
        SearchOptions(budget=3, max_descend=4, max_related=2, max_symbols=2, target=3, branch=3, limit=4,
                      scoring_limit=6),
        SearchOptions(budget=9, min_confidence=0.5, branch=2, max_symbols=1),
    ],
)
def test_all_walks_equal_single_walks(spark, options):
    map_, names = made_map(spark, 4)
    intents = ["the cold anchor", "winches and ropes on deck", "", "nothing known", "hull plank sail mast"]
    objectives = spark.createDataFrame(list(enumerate(intents)), "objective int, intent string")
    walks = walk.walk_all(map_, objectives, options)
    states = {r["objective"]: (r["steps"], r["stop"]) for r in walks.states.collect()}
    found = {}
    for r in walks.found.collect():
        found.setdefault(r["objective"], {})[r["path"]] = (r["retrieval"], [tuple(t) for t in r["trail"]])
    ranked = {}
    for r in walk.search_all(map_, objectives, options).orderBy("objective", "position").collect():
        ranked.setdefault(r["objective"], []).append((r["path"], r["relevance"], r["priority"], len(r["trail"])))
    for at, intent in enumerate(intents):
        single, steps, stop, _, _ = search.walk(map_, intent, LexicalJudge(), options)
        assert states[at] == (steps, stop), intent
        want = {
            f.path: (pytest.approx(f.retrieval), [tuple(t.values()) for t in f.trail]) for f in single
        }
        assert found.get(at, {}) == want, intent
        result = search.search(map_, intent, LexicalJudge(), options)
        assert ranked.get(at, []) == [
            (o["path"], pytest.approx(o["relevance"]), o["priority"], len(o["trail"])) for o in result.opportunities
        ]


def test_no_objectives_and_no_units(spark):
    map_, _ = made_map(spark, 1)
    none = spark.createDataFrame([], "objective int, intent string")
    assert walk.search_all(map_, none).count() == 0
    empty_nodes = map_.nodes.where("false")
    empty = search.SearchMap(empty_nodes, map_.relations.where("false"), map_.leaders.where("false"))
    one = spark.createDataFrame([(1, "anchor"), (2, None)], "objective int, intent string")
    walks = walk.walk_all(empty, one)
    assert walks.found.count() == 0
    assert sorted(tuple(r) for r in walks.states.collect()) == [(1, 0, "exhausted"), (2, 0, "exhausted")]


def test_symbol_scores_match_word_lists(spark):
    rng = random.Random(9)
    vocabulary = ["cach", "cache", "cached", "cac", "loader", "load", "loa", "prune", "pruned", "abc", "abcd", "abcde"]
    units = [
        unit(f"src/{rng.choice(vocabulary)}/{rng.choice(vocabulary)}{i}.ts", 1,
             exports=[rng.choice(vocabulary) + rng.choice(vocabulary).title() for _ in range(rng.randrange(4))])
        for i in range(40)
    ]
    nodes = tree.node_table(run_of(spark, units))
    intents = [" ".join(rng.choices([*vocabulary, "the", "zz"], k=rng.randrange(6))) for _ in range(30)]
    asked = symbols.with_terms(spark.createDataFrame(list(enumerate(intents)), "objective int, intent string"))
    got = {(r["objective"], r["path"]): (r["score"], r["label"]) for r in symbols.symbol_scores(asked, nodes).collect()}
    want = {}
    for at, intent in enumerate(intents):
        terms = query_words(intent)
        for path, *_, exports, _ in units:
            score = matched(terms, symbol_words(path, exports))
            if score:
                best, label = 0, path.rsplit("/", 1)[-1]
                for symbol in exports:
                    n = sum(any(_pair(t, w) for w in words(symbol)) for t in terms)
                    if n > best:
                        best, label = n, symbol
                want[at, path] = (score, label)
    assert got == want and want


def test_relations_of_a_map_of_packages(spark):
    """A map made from a factorised graph offers what one made from all edges offers."""
    from sextant.operators.packages import Links

    names = [f"go/p{i % 3}/f{i}.go" for i in range(9)]
    members = [(n.rsplit("/", 1)[0], n) for n in names]
    uses = [(names[0], "go/p1"), (names[1], "go/p1"), (names[4], "go/p0"), (names[8], "go/p2")]
    links = Links(
        edges_of(spark, [(names[2], names[5])]), spark.createDataFrame(uses, "src string, package string"),
        spark.createDataFrame(members, "package string, path string"),
    )
    run = run_of(spark, [unit(n, 1) for n in names])
    nodes = tree.node_table(run)
    both = [
        sorted(tuple(r)[:3] for r in search.relation_table(nodes, e, tools.coupling_rows(run)).collect())
        for e in (links, links.written_out())
    ]
    assert both[0] == both[1] and both[0]


def made_symbols(spark):
    """Units and objectives of few words, some of them twice."""
    rng = random.Random(4)
    words = ["cach", "cache", "cached", "loader", "load", "prune", "part", "partial", "none"]
    exports = [[rng.choice(words) + "_" + rng.choice(words) for _ in range(rng.randrange(3))] for _ in range(50)]
    rows = [(f"s/{rng.choice(words)}/f{i}.ts", f"f{i}.ts", e, "unit") for i, e in enumerate(exports)]
    rows += [rows[0], (*rows[1][:2], ["prune_load"], "unit"), ("s", "s", [], "area"), ("s/x", "x", None, "unit")]
    nodes = spark.createDataFrame(rows, "path string, name string, exports array<string>, kind string")
    intents = [(i, " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(30)]
    intents += [intents[3], (4, "cached part"), (90, None)]
    return symbols.with_terms(spark.createDataFrame(intents, "objective int, intent string")), nodes


def test_symbol_scores_of_repeated_rows(spark):
    asked, nodes = made_symbols(spark)
    units = [r for r in nodes.collect() if r["kind"] == "unit"]
    rows, tokens, terms = asked.collect(), {}, {}
    for unit_ in units:
        if unit_["exports"] is not None:
            tokens.setdefault(unit_["path"], set()).update(symbol_words(unit_["path"], unit_["exports"]))
    for row in rows:
        terms.setdefault(row["objective"], set()).update(row["terms"])
    want = []
    for row in rows:
        for unit_ in units:
            score = matched(sorted(terms[row["objective"]]), sorted(tokens.get(unit_["path"], [])))
            if score:
                best, label = 0, unit_["name"]
                for symbol in unit_["exports"]:
                    n = sum(any(_pair(t, w) for w in words(symbol)) for t in row["terms"])
                    if n > best:
                        best, label = n, symbol
                want.append((row["objective"], unit_["path"], score, label))
    got = [tuple(r) for r in symbols.symbol_scores(asked, nodes).collect()]
    assert sorted(got) == sorted(want) and want


def test_the_best_symbols_lead_the_scores(spark):
    asked, nodes = made_symbols(spark)
    scores = {}
    for r in symbols.symbol_scores(asked, nodes).collect():
        scores.setdefault(r["objective"], []).append((-r["score"], r["path"]))
    want = [
        (o, slot, path) for o, found in scores.items()
        for slot, (_, path) in enumerate(sorted(found, key=lambda f: (f[0], locale_key(f[1])))[:4], 1)
    ]
    got = [(r["objective"], r["slot"], r["path"]) for r in symbols.best_symbols(asked, nodes, 4).collect()]
    assert sorted(got) == sorted(want)


def test_equal_rows_are_scored_once(spark):
    """Pairs are made of classes: neither the units of a class nor its objectives multiply them."""
    nodes = spark.range(300).selectExpr(
        "concat('a/f', id, '.ts') AS path", "concat('f', id, '.ts') AS name", "array('load_page') AS exports",
        "'unit' AS kind",
    )
    asked = symbols.with_terms(spark.range(40).selectExpr("id AS objective", "concat('loading x', id) AS intent"))
    found = symbols.matches(asked, nodes)
    assert found.pairs.count() == 1
    assert symbols.symbol_scores(asked, nodes).count() == 300 * 40


def test_term_counts_without_a_broadcast(spark):
    asked, nodes = made_symbols(spark)
    index = symbols.token_index(nodes)
    pairs = [(r["token"], r["path"]) for r in index.collect()]
    want = set()
    for term in {t for r in asked.collect() for t in r["terms"]}:
        met = [(w, path) for w, path in pairs if _pair(term, w)]
        if met:
            want.add((term, len({w for w, _ in met}), len({p for _, p in met})))
    assert {tuple(r) for r in symbols.term_counts(asked, index).select("term", "tokens", "units").collect()} == want
    plan = symbols.term_tokens(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
