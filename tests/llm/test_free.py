"""Near duplicates, pieces, toxicity, licenses and repeated passages against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import licenses, neardup, pieces, repeats, toxicity
from sextant.llm.graph import connect
from sextant.llm.lcp_merge import common, make_run, merge, pack, unpack


def _shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _components(rows, k, percent):
    sets = [_shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_components_match_brute_force(docs, got, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É é")]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 40, 150, 700]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // (8 * k)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(words)))
    found = neardup.near_components(docs(rows), words=k)
    want = _components(rows, k, 80)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(
        ((d, len(_shingles(t, k)), c, c == d) for (d, t), c in zip(rows, want, strict=True)), key=repr
    )


def test_near_components_of_a_chain_and_strays(docs, got):
    """A large group in which many pairs are below the limit: links go through other members."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    found = neardup.near_components(docs(rows), words=2)
    want = _components(rows, 2, 80)
    assert got(found, "doc_id", "component_id") == sorted(
        ((d, c) for (d, _), c in zip(rows, want, strict=True)), key=repr
    )


def test_near_duplicates_keep_one_row_and_all_columns(docs):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (1, text + " more"), (None, text), (8, None)]
    kept = neardup.keep_distinct(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 8]
    assert neardup.keep_distinct(docs(rows).limit(0)).count() == 0


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**64, 4000, np.uint64)
    own = rng.integers(0, 2**64, (2, 500), np.uint64)
    a, b = (np.unique(np.r_[shared, x]) for x in own)
    value, used = neardup.estimated(neardup.registers(a), neardup.registers(b), len(a), len(b))
    assert used == 256 and abs(value - 0.8) < 6 * math.sqrt(0.16 / 256)
    x, y = (np.unique(rng.integers(0, 2**64, 3000, np.uint64)) for _ in range(2))
    assert abs(neardup.estimated(neardup.registers(x), neardup.registers(y), 3000, 3000)[0]) < 0.02


def test_connect_joins_long_chains(spark, got):
    nodes = spark.range(60).selectExpr("id AS node", "id AS comp")
    links = spark.range(58).where("id != 30").selectExpr("id + 1 AS a", "id AS b")
    want = [(i, 0 if i <= 30 else 31 if i < 59 else 59) for i in range(60)]
    assert sorted(tuple(r) for r in connect(nodes, links).select("node", "comp").collect()) == want


VOCABULARY = [
    ("<unk>", 0.0, "control"), *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256)),
    *((p, s, "piece") for p, s in {
        "▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.5, "ba": -6.0, "aba": -9.0, "▁a": -5.0,
        "bb": -7.5, "abab": -11.0, "▁▁": -5.0,
    }.items()),
]


def _best(lattice, text):
    """The best score over all segmentations."""
    best = [0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        options = []
        for s in range(e):
            found = lattice.prefixes.get(text[s:e])
            if found:
                options.append(best[s] + found[0])
            elif e - s == 1:
                options.append(best[s] + lattice.unknown)
        best[e] = max(options)
    return best[-1]


def test_pieces_are_the_best_path_and_round_trip():
    lattice = pieces.Lattice(VOCABULARY)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aabb ab\n▁cé") for _ in range(rng.randrange(0, 14)))
        ids = lattice.encode(text)
        assert lattice.decode(ids) == text
        ready = pieces.prepared(text, True)
        assert lattice.whole(ready)[0] == (_best(lattice, ready) if ready else 0)
        assert ids == lattice.whole(ready)[1]


def _as_unigram(model):
    """The model file as one of unigram kind, with the scores the lattice uses."""
    import struct

    import sentencepiece

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    data = sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto()
    scores = pieces.load_vocabulary(model)
    at, number, out = 0, 0, bytearray()
    while at < len(data):
        start = at
        key, at = varint(at)
        length, at = varint(at)
        body = bytearray(data[at : at + length])
        if key == 10:  # a piece: its text, then its score
            place = 2 + body[1]
            if scores[number][2] == "piece":
                body[place + 1 : place + 5] = struct.pack("<f", scores[number][1])
            number += 1
        elif key == 18:  # training: the kind of model
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += data[start:at] + body
        at += length
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def test_pieces_match_the_library_on_a_unigram_model(spark):
    library = _as_unigram(pieces.MODEL)
    vocabulary = pieces.load_vocabulary()
    lattice = pieces.Lattice(vocabulary)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lines = [line[:200] for (text,) in texts for line in text.split("\n")]
    other = 0
    for line in lines:
        mine, theirs = lattice.encode(line), library.encode(line)
        if mine != theirs:  # equal sums, as in three equal characters
            a, b = (sum(vocabulary[i][1] for i in ids) for ids in (mine, theirs))
            assert abs(a - b) < 1e-3
            other += 1
    assert other < 0.05 * len(lines)


def test_texts_encoded_at_a_time_are_bounded():
    texts = ["x" * 300_000] * 11 + ["", "y" * 3_000_000, "z"]
    parts = list(pieces.parts_of(texts))
    assert [i for start, end in parts for i in range(start, end)] == list(range(len(texts)))
    sizes = [sum(map(len, texts[start:end])) for start, end in parts]
    assert all(size <= 1 << 20 or end == start + 1 for size, (start, end) in zip(sizes, parts, strict=True))
    assert list(pieces.parts_of([])) == []


def test_giant_texts_get_the_pieces_of_whole_ones(spark, docs):
    rng = random.Random(6)
    words = ["hello", "thought", "é漢", "x▁y", "the", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 30, 400])]
    rows += [(10, "".join(rng.choice("etaoinshrdlu") for _ in range(900))), (11, None), (12, "  a  ")]
    rows += [(10, "z" * 500), (None, "ab" * 300)]
    coder = pieces.Pieces(spark, chunk=40)
    lattice = pieces.Lattice(pieces.load_vocabulary())
    back = coder.decode(coder.encode(docs(rows)))
    assert set(back.columns) == {*docs(rows).columns, "decoded"}
    found = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in back.collect()), key=repr)
    want = [(i, t, lattice.encode(t or ""), t or "") for i, t in rows]
    assert found == sorted(want, key=repr)
    assert coder.encode(docs(rows).limit(0)).count() == 0


def test_toxicity_of_odd_rows(spark, docs):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "te") for b in ("ne", "ssi", "do", "gar", "pul")]

    def plain(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, f"{plain(20)} {'you idiot' if i % 2 else 'as ever'} {plain(20)}") for i in range(200)]
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int"
    )
    model = toxicity.train(docs(rows), labels)
    long = plain(60_000)
    odd = [(100, None), (101, ""), (102, f"{long} you idiot {long}"), (103, long), (103, long)]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs(odd), model).collect()}
    assert found[102] > 0.5 and found[102] > found[103] and found[100] == found[101]
    assert all(0 <= s <= 1 for s in found.values())
    nothing = toxicity.train(docs(rows), labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs(odd), nothing).collect()} == {0.5}


def test_license_templates(docs):
    mit = licenses.words_of(licenses.TEMPLATES["mit-text"].replace("<<opt>>", "").replace("<</opt>>", "").replace("<<var:1-20>>", "the authors"))
    text = b" ".join(mit).decode()
    short = text[: text.index("including the next")] + text[text.index("shall be included") : text.index("the software is provided as")]
    rows = [
        (1, "The MIT-License! Then: Apache (license)."), (2, None), (3, ""), (4, f"é {text} end"),
        (5, f"{short} MIT License"), (6, text.replace("charge", "cost")), (7, "mit"),
        (8, "mit license " * 20_000), (8, "x"), (9, "SPDX-License-Identifier: MIT"),
    ]
    found = {}
    for r in licenses.scan(docs(rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    labels = {k: {p["label"] for p in v[0]["places"]} for k, v in found.items()}
    assert labels[1] == {"mit", "apache"} and labels[2] == labels[3] == labels[7] == set()
    assert labels[4] == {"mit-text"} and labels[5] == {"mit-text", "mit"} and labels[6] == set()
    assert [(p["start"], p["end"]) for p in found[1][0]["places"]] == [(1, 3), (4, 6)]
    assert sorted(len(r["places"]) for r in found[8]) == [0, 20_000]
    assert labels[9] == {"spdx-line"}


def test_front_coded_runs_merge_in_order():
    rng = random.Random(8)
    rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))), i) for i in range(500)]
    runs = [unpack(pack(make_run(rows[i::7]))) for i in range(7)]
    out = list(merge(runs))
    assert [t for _, t, _ in out] == sorted(t for t, _ in rows)
    assert [n for n, *_ in out[1:]] == [common(a, b) for (_, a, _), (_, b, _) in zip(out, out[1:], strict=False)]
    assert sorted(i for *_, i in out) == list(range(500)) and list(merge([])) == []


def _removed(rows, length):
    count = {}
    for _, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            count[data[i : i + length]] = count.get(data[i : i + length], 0) + 1
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_passages_match_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "GROUP", 2 if hot else 20_000)
    monkeypatch.setattr(repeats, "SEGMENT", 150)
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [noise(n) for n in (45, 60, 90, 200)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 300), (5, "ab" * 100), (6, "é" * 60)]
    for i in range(60):
        parts = [x for _ in range(rng.randrange(1, 5)) for x in (noise(rng.randrange(0, 60)), rng.choice(shared)[rng.randrange(0, 20) :])]
        rows.append((10 + i, "".join(parts)))
    rows += [(90, rows[-1][1]), (91, rows[-1][1]), (91, rows[-1][1]), (None, noise(100))]
    found = repeats.remove_repeats(docs(rows), length=40, gram=8)
    made = sorted(
        (
            (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest())
            for r in found.collect()
        ),
        key=repr,
    )
    assert made == _removed(rows, 40)


def test_repeated_passages_of_nothing(docs):
    assert repeats.remove_repeats(docs([(1, "a")]).limit(0)).count() == 0
    (row,) = repeats.remove_repeats(docs([(1, "a" * 399)])).collect()
    assert (row["n_removed"], row["n_bytes"]) == (0, 399)
