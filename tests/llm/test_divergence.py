"""The audit against dictionaries."""

import random
import re
from collections import Counter, defaultdict

from sextant.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def _expected(rows, least, top):
    docs = [((lang or ""), (source or ""), text or "") for _, text, lang, source in rows]
    words = [
        re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        for _, _, text in docs
    ]
    having, own, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), found in zip(docs, words, strict=True):
        having[lang].update(set(found))
        whole[lang].update(found)
        own[lang, source].update(found)
    out = []
    for lang, source in own:
        kept = {t for t, n in having[lang].items() if n >= least}
        total = sum(whole[lang][t] for t in kept)

        def share(counts, size, kept=kept):
            return {t: 1 + 10**9 * (counts[t] + 5) // (size + 5 * len(kept)) for t in kept}

        def of(name, lang=lang, kept=kept, share=share):
            return share(own[lang, name], sum(own[lang, name][t] for t in kept))

        p, q = of(source), share(whole[lang], total)
        pairs = [
            (sum(abs(p[t] - o[t]) for t in kept), name)
            for name in {s for at, s in own if at == lang and s != source}
            for o in [of(name)]
        ]
        terms = [(p[t] - q[t], t) for t in kept if own[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            for rank, (value, item) in enumerate(ordered, 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def _found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = divergence.audit(docs, **kw)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def test_audit_matches_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 40)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    rng = random.Random(2)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "éa", "日本", "a\u0085b"]
    rows = []
    for i in range(160):
        size = rng.choice([0, 3, 30, 200])
        text = rng.choice([" ", "-", "7", "\n"]).join(rng.choices(words, range(1, 65), k=size))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None, "s3"])))
    rows += [(5, None, "fr", "s0"), (6, "only here", "fr", "s1"), (6, "only here", "fr", "s1"), (7, "", "it", "s9")]
    rows += [(None, "wa " * 50_000 + "x" * 300_000, "en", "s4")]
    assert _found(spark, rows, least_docs=8, top_terms=5) == _expected(rows, 8, 5)


def test_a_full_table_is_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_TERMS", 3)
    rows = [(i, "aa bb cc dd ee ff", "en", f"s{i % 3}") for i in range(9)]
    assert _found(spark, rows, least_docs=9) == _expected(rows, 9, 50)
    assert _found(spark, rows, least_docs=10) == _expected(rows, 10, 50)


def test_nothing(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, "a b", "en", "s0")]) == []
