"""Operators made of expressions: exact dedup, mixing, secrets, chats, quality rules."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, exact, mixing, quality, secrets
from sextant.llm.common import new_folder

ODD = [
    (1, None), (2, ""), (3, "same text"), (4, "same text"), (9, "same text"), (5, "same  text"),
    (None, "same text"), (6, "word " * 30_000), (7, "only▁one é漢"), (7, "only▁one é漢"),
]


def test_exact_dedup_keeps_the_largest_id(spark, docs, got):
    index = exact.DigestIndex(spark, new_folder(spark, "t"), 4)
    found = index.deduplicate(docs(ODD))
    rows = got(found, "doc_id", "keep_id", "group_size", "kept")
    assert (9, 9, 4, True) in rows and (3, 9, 4, False) in rows and (None, 9, 4, False) in rows
    assert (1, 2, 2, False) in rows and (2, 2, 2, True) in rows  # null is the empty text
    assert [r[3] for r in rows if r[0] == 7] in ([True, False], [False, True])  # a repeated row
    assert len(rows) == len(ODD)


def test_exact_dedup_against_earlier_batches(spark, docs, got):
    index = exact.DigestIndex(spark, new_folder(spark, "t"), 4)
    first = docs([(1, "a"), (2, "b"), (8, "b")])
    assert sum(r[0] for r in got(index.deduplicate(first, batch="one"), "kept")) == 2
    again = index.deduplicate(first, batch="one")  # run again after a failure
    assert sum(r[0] for r in got(again, "kept")) == 2
    later = index.deduplicate(docs([(20, "b"), (21, "c")]), batch="two")
    assert got(later, "doc_id", "keep_id", "known", "kept") == [
        (20, 8, True, False), (21, 21, False, True),
    ]
    reopened = exact.DigestIndex(spark, index.path, 4)
    assert reopened.known().count() == 3


def test_exact_dedup_index_is_read_without_a_shuffle(spark, docs):
    index = exact.DigestIndex(spark, new_folder(spark, "t"), 4)
    index.deduplicate(docs([(1, "a")]), batch="one")
    plan = index.known().join(index.known().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_keep_new_keeps_all_columns(spark, docs, got):
    index = exact.DigestIndex(spark, new_folder(spark, "t"), 4)
    kept = exact.keep_new(docs(ODD), index)
    assert kept.columns == docs(ODD).columns
    assert kept.count() == 5 and exact.keep_new(docs(ODD), index).count() == 0


def test_mixing_meets_its_rates(spark, got):
    rows = [(i, "x" * 10, "en", "src0" if i % 3 else "src1", 1, "x") for i in range(6000)]
    rows += [(7000, None, "en", None, 1, "x"), (7001, "", "en", "other", 1, "x")]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row long, ids string"
    )
    mixed = mixing.mix(table, {"src0": 0.25, "src1": 0.75, "absent": 3.0}, rest=0.5)
    counts = Counter(r[0] for r in mixed.select("source").collect())
    # The rest has no characters: the weights of the two sources count alone.
    assert abs(counts["src0"] - 1500) < 150 and abs(counts["src1"] - 4500) < 250
    assert set(counts) == {"src0", "src1"}
    again = mixing.mix(table.repartition(7), {"src0": 0.25, "src1": 0.75, "absent": 3.0}, rest=0.5)
    assert got(mixed, "doc_id", "__copy") == got(again, "doc_id", "__copy")
    assert mixing.mix(table.limit(0)).count() == 0


def test_poisson_steps_are_the_distribution():
    for mean in (0.01, 1.0, 30.0, 900.0):
        steps = mixing.poisson_steps(mean)
        law = [b - a for a, b in zip([0.0, *steps], steps, strict=False)]
        assert abs(sum(law) - 1) < 1e-9
        assert abs(sum(k * p for k, p in enumerate(law)) - mean) < 1e-6 * max(1, mean)
    assert mixing.poisson_steps(0) == []


def _base_spans(text):
    out = []
    patterns = [
        ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    for order, (kind, pattern, group, least) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_secrets_base_spans_and_ownership(spark, got):
    live, shared = "Zq8xK2mN5vB7wL3t", "EXAMPLEEXAMPLE1"
    texts = [
        (1, f"é token='{live}' end", "a"), (2, f"Token: {shared}", "a"), (3, f"token={shared}", "b"),
        (4, f'api_key="{shared}"', "c"), (5, "token=token\": abcdefgh", "a"), (6, None, None),
        (7, "", "b"), (8, "AKIA" + "A1" * 10 + " " + "0123456789abcdef" * 2 + "g", "b"),
        (9, f"token='{live}' token = '{live}'\nsecret: abc", "a"), (9, "passwd=12345 AKIAshort", "a"),
    ]
    rows = [(i, t, "en", s, 1, "x") for i, t, s in texts]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row long, ids string"
    )
    found = secrets.find_secrets(table)
    base = found.select("doc_id", secrets._listed(F.filter("spans", lambda s: s["base"])).alias("b"))
    want = sorted(((i, _base_spans(t or "")) for i, t, _ in texts), key=repr)
    assert got(base, "doc_id", "b") == want
    spans = {(r[0], s["kind"], s["verdict"]) for r in found.collect() for s in r["spans"]}
    assert (1, "live", "live") in spans and (9, "live", "live") in spans  # one owner
    assert (2, "assign", "example") in spans and (2, "live", "example") not in spans
    assert secrets.find_secrets(table.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = "\\ \\l <|turn|> </s>[INST] <<SYS>> \\\\<|end|>\n<|next|> é"
    rows = [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", "x"),
        (1, 3, "us\ner<|end|>", None), (2, 5, None, "a"), (2, None, "assistant", ""),
        (2, 5, None, "a"), (None, 1, "assistant", "z"), (3, 0, "user", "y" * 100_000),
    ]
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows, schema).withColumn("formatted", F.lit(1))
    made = chat.format_chats(table)
    back = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    turns = [(t["role"], t["text"]) for t in back[1]["turns"]]
    assert turns == [(r[2], r[3] or "") for r in rows[:4]]
    assert back[1]["masked"] == [nasty, "x"]
    assert back[1]["formatted"].count(chat.OPEN) == 3  # the two assistant turns are one block
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("assistant", ""), ("", "a"), ("", "a")]
    assert back[None]["masked"] == ["z"] and back[3]["masked"] == []
    assert chat.format_chats(table.limit(0)).count() == 0


def _repeated(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return len(inside)


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t", "a b c", "a " * 40, "one two three four five six seven eight " * 3 + "end",
        "x " * 7, "x " * 8, "x " * 9, "p q r s t u v w z p q r s t u v w\n" + "z " * 9, None,
        " ".join(str(i % 977) for i in range(20_000)),
    ],
)
def test_quality_signals(spark, docs, text):
    row = quality.with_words(docs([(1, text)])).select(
        *(quality.signal(n).alias(n) for n in (*quality.REPORTED, "n_lines"))
    ).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
    assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_lines"] == len(lines)
    assert row["n_repeat_words"] == _repeated(words)


def test_quality_cascade_gives_one_verdict_in_every_order(docs, got):
    rows = [
        (1, None), (2, "a b"), (3, "same old words " * 50), (4, " ".join(f"word{i} |" for i in range(60))),
        (5, " ".join(f"w{i}" for i in range(100))), (5, " ".join(f"w{i}" for i in range(100))),
        (6, "\n".join(["line of text"] * 30)), (7, " ".join(f"LOUD{i}!!" for i in range(60))),
    ]
    table = quality.with_words(docs(rows))
    verdicts = [
        got(quality.assess(table, order).select("doc_id", F.col("rejected_by").isNull().alias("k")), "doc_id", "k")
        for order in (quality.RULES, quality.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1]
    assert [r for r in verdicts[0] if r[1]] == [(5, True), (5, True)]
    kept = quality.keep_good(docs(rows))
    assert kept.columns == docs(rows).columns and kept.count() == 2
    assert quality.keep_good(docs(rows).limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(docs):
    rows = [(i, "a b" if i % 2 else " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)]
    measured = quality.measure_rules(docs(rows), fraction=1.0)
    assert measured[0]["selectivity"] > 0 and measured[0]["gain"] >= measured[-1]["gain"]
    assert {m["rule"].name for m in measured} == {r.name for r in quality.RULES}


def test_digest_is_that_of_the_text(spark, docs):
    index = exact.DigestIndex(spark, new_folder(spark, "t"), 2)
    row = index.deduplicate(docs([(1, "é")])).select(exact.digest_hex().alias("h")).first()
    assert row["h"] == hashlib.sha256("é".encode()).hexdigest()
