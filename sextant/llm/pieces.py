"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is segmented into the pieces of a vocabulary so that the sum of their scores is largest; of
equal sums, the one with the longest last piece, then the longest before it. Characters that no
piece covers become their UTF-8 bytes. Decoding gives back the text exactly.

Two facts keep this cheap and parallel. Where no piece contains two neighbouring characters, every
path passes between them: texts fall apart into short runs, and the best path of a run is
remembered. Giant texts are split into chunks that different tasks work on: a path enters and leaves
a chunk in one of few states (how many characters a piece reaches across the border), so a chunk is
a small matrix of best scores in the max-plus semiring. The matrices of a text are multiplied in
order, which gives the scores at each border; every chunk then finds, by itself, for each state it
may be left in the state it was entered in; composing these maps from the end fixes the states, and
every chunk is backtraced on its own. Scores are whole numbers, so the product is associative
exactly, and chunked and whole texts get the same pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sextant.llm.common import hex_sha256, stored, table, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; texts of more than twice as many are split.
CHUNK = 1 << 14
SPACE = "▁"
#: Stands for a SPACE that is in the text itself. A lone surrogate is in no valid text and in no
#: piece, so it becomes the bytes of the character.
LITERAL = "\udfff"
SCALE = 1 << 16
NONE = -(1 << 62)
#: Runs whose pieces a worker remembers at most, and the longest run it remembers.
MEMO_RUNS, MEMO_LENGTH = 100_000, 64
#: So many new runs and more are segmented together; characters of texts that are encoded at a time,
#: which bound a worker's memory.
TOGETHER, CHARACTERS = 1_000, 1 << 20


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """Piece, score and kind ('piece', 'byte' or 'control') by id, read by the driver.

    The lattice adds log-probabilities, which the scores of a unigram model are. Scores that are
    all whole numbers are merge ranks instead; each then stands for the probability that Zipf's law
    gives to its rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        if model.is_byte(i):
            return "byte"
        return "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"

    rows = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(len(model))]
    if not all(score.is_integer() for _, score, what in rows if what == "piece"):
        return rows
    total = math.log(sum(1 / (i + 1) for i in range(len(rows))))
    ranks = iter(range(len(rows)))
    return [
        (piece, -math.log(next(ranks) + 2) - total if what == "piece" else score, what)
        for piece, score, what in rows
    ]


class _Table:
    """Prefixes of pieces by the hash of their characters, for looking up many at a time. Entry 0 is
    none; a prefix that is no piece has no id and a score that never wins."""

    BITS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, prefixes: dict[str, tuple[int, int] | None], width: int) -> None:
        self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(width, self.BASE)])
        self.keys = np.zeros(len(prefixes) + 1, np.uint64)
        self.scores = np.full(len(prefixes) + 1, NONE, np.int64)
        self.ids = np.full(len(prefixes) + 1, -1, np.int32)
        for i, (prefix, piece) in enumerate(prefixes.items(), 1):
            codes = np.frombuffer(prefix.encode("utf-32-le"), np.uint32)[:, None]
            self.keys[i] = self.hashes(codes)[-1, 0]
            if piece is not None:
                self.scores[i], self.ids[i] = piece
        entries = np.arange(1, len(prefixes) + 1, dtype=np.int32)
        places = self.slot(self.keys[1:])
        self.first = np.zeros(1 << self.BITS, np.int32)
        self.first[places] = entries
        # Prefixes whose place is taken are in a sorted list.
        rest = entries[self.first[places] != entries]
        self.rest = rest[np.argsort(self.keys[rest])]
        self.rest_keys = self.keys[self.rest]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of texts that are the columns of ``codes``."""
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
        for i in range(len(codes)):
            out[i + 1] = out[i] * self.BASE + x[i]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of the keys, 0 where there is none."""
        found = self.first[self.slot(keys)]
        other = np.flatnonzero((self.keys[found] != keys) & (found != 0))
        if len(other):
            at = np.minimum(np.searchsorted(self.rest_keys, keys[other]), max(len(self.rest) - 1, 0))
            known = self.rest_keys[at] == keys[other] if len(self.rest) else np.zeros(len(other), bool)
            found[other] = np.where(known, self.rest[at] if len(self.rest) else 0, 0)
        return found


class _Memo(dict):
    """Ids of runs, remembered."""

    def __init__(self, lattice: Lattice) -> None:
        super().__init__()
        self.lattice = lattice

    def __missing__(self, run: str) -> tuple[int, ...]:
        found = tuple(self.lattice.whole(run)[1])
        if len(run) <= MEMO_LENGTH:
            self[run] = found
        return found

    def learn(self, runs: list[list[str]]) -> None:
        """Finds the best paths of all new runs at once, where there are many. A full memory keeps
        what these texts use."""
        wanted = set(chain.from_iterable(runs))
        if len(self) >= MEMO_RUNS:
            kept = {run: self[run] for run in wanted & self.keys()}
            self.clear()
            self.update(kept)
        by_length: dict[int, list[str]] = {}
        new = wanted.difference(self)
        for run in new if len(new) >= TOGETHER else ():
            if len(run) <= MEMO_LENGTH:
                by_length.setdefault(-(-len(run) // 4), []).append(run)
        for same in by_length.values():
            for start in range(0, len(same), 20_000):
                self.lattice.many(same[start : start + 20_000], self)


class Lattice:
    """Best paths over one vocabulary. ``prefixes`` maps each prefix of a piece to the piece's
    (score, id), or to None where the prefix is no piece."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]) -> None:
        self.surfaces = surfaces_of(vocabulary)
        self.byte_ids = [0] * 256
        self.prefixes: dict[str, tuple[int, int] | None] = {}
        self.pairs: set[str] = set()
        self.width, least = 1, 0.0
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
            if kind != "piece":
                continue
            for end in range(1, len(piece)):
                self.prefixes.setdefault(piece[:end], None)
                self.pairs.add(piece[end - 1 : end + 1])
            self.prefixes[piece] = (round(score * SCALE), i)
            self.width, least = max(self.width, len(piece)), min(least, score)
        #: An uncovered character costs more than any piece.
        self.unknown = round((least - 10) * SCALE)
        inner = any(SPACE in pair[1:] and pair[0] != SPACE for pair in self.pairs)
        alone = "\n" if not any("\n" in pair for pair in self.pairs) else ""
        self.runs = None if inner else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n")
        self.memo = _Memo(self)
        self.table = _Table(self.prefixes, self.width)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (SPACE if char == LITERAL else char).encode()]

    def forward(
        self, text: str, entry: list[int], n: int
    ) -> tuple[list[int], list[int]]:
        """Best score and last piece's start at each position of ``text``, from ``entry`` scores at
        the first positions. Pieces start before ``n``; start -1 marks the entry itself."""
        size = len(text)
        best = entry[: size + 1] + [NONE] * (size + 1 - len(entry))
        back = [-1] * (size + 1)
        prefixes, width = self.prefixes, self.width
        for s in range(n):
            at = best[s]
            if at == NONE:
                continue
            single = False
            for e in range(s + 1, min(size, s + width) + 1):
                found = prefixes.get(text[s:e], False)
                if found is False:
                    break
                if found is not None:
                    single = single or e == s + 1
                    if at + found[0] > best[e]:
                        best[e], back[e] = at + found[0], s
            if not single and at + self.unknown > best[s + 1]:
                best[s + 1], back[s + 1] = at + self.unknown, s
        return best, back

    def backward(self, text: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """The entry position of the best path that ends at ``end``, and its ids."""
        cuts = [end]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        ids: list[int] = []
        for e, s in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            found = self.prefixes.get(text[s:e])
            if found is None:
                ids.extend(self.bytes_of(text[s:e]))
            else:
                ids.append(found[1])
        return cuts[-1], ids

    def whole(self, text: str) -> tuple[int, list[int]]:
        best, back = self.forward(text, [0], len(text))
        return best[-1], self.backward(text, back, len(text))[1]

    def many(self, texts: list[str], memo: dict) -> None:
        """Puts the best paths of texts of similar length into ``memo``: the same steps as in
        ``forward``, on all texts at a time. Shorter ones are filled up; what follows a text's end
        has no part in its path."""
        lengths = np.array([len(text) for text in texts])
        n, count, table = int(lengths.max()), len(texts), self.table
        filled = "".join([text.ljust(n, "\0") for text in texts])
        codes = np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = table.hashes(codes.reshape(count, n).T)
        best = np.full((n + 1, count), NONE, np.int64)
        best[0] = 0
        back = np.zeros((n + 1, count), np.int8)
        entry = np.zeros((n + 1, count), np.int32)

        def offer(end: int, some: np.ndarray, value: np.ndarray, s: int, found) -> None:
            better = value > best[end, some]
            some = some[better]
            best[end, some], back[end, some] = value[better], s
            entry[end, some] = found[better]

        for s in range(n):
            # Texts that go on, and of them those whose characters from here on begin a piece.
            some = np.flatnonzero(lengths > s)
            from_here = hashes[s]
            for size in range(1, min(self.width, n - s) + 1):
                found = table.find(hashes[s + size, some] - from_here[some] * table.powers[size])
                if size == 1:
                    alone = table.ids[found] < 0
                    bare = some[alone]
                    offer(s + 1, bare, best[s, bare] + self.unknown, s, np.zeros(len(bare), np.int32))
                some, found = some[found > 0], found[found > 0]
                if not len(some):
                    break
                piece = table.ids[found] >= 0
                offer(s + size, some[piece], best[s, some[piece]] + table.scores[found[piece]], s, found[piece])
        at, column = lengths.copy(), np.arange(count)
        steps = []
        odd = np.zeros(count, bool)
        while (at > 0).any():
            used = entry[at, column]
            odd |= (used == 0) & (at > 0)
            steps.append(np.where(at > 0, table.ids[used], -1))
            at = back[at, column].astype(np.int64)
        ids = np.stack(steps[::-1]).T
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        flat, start = ids[ids >= 0].tolist(), 0
        for text, end in zip(texts, ends, strict=True):
            memo[text] = tuple(flat[start:end])
            start = end
        for i in np.flatnonzero(odd).tolist():  # holds characters that no piece covers
            memo[texts[i]] = tuple(self.whole(texts[i])[1])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of many texts."""
        ready = [prepared(text, True) for text in texts]
        if self.runs is None:
            return [self.whole(text)[1] for text in ready]
        runs = [self.runs.findall(text) for text in ready]
        self.memo.learn(runs)
        get = self.memo.__getitem__
        return [list(chain.from_iterable(map(get, parts))) for parts in runs]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def stretch(self, text: str) -> list[int]:
        """Ids of a stretch between two places that every path passes."""
        parts = self.runs.findall(text) if self.runs else [text]
        return list(chain.from_iterable(map(self.memo.__getitem__, parts)))

    def prepare_chunks(self, texts: list[str]) -> None:
        if self.runs:
            self.memo.learn([self.runs.findall(text) for text in texts])

    def decode(self, ids) -> str:
        return decoded(self.surfaces, ids)

    def cut(self, text: str, at: int, step: int) -> int:
        """The first place from ``at`` on, in steps of 1 or -1, that every path passes; -1 if none."""
        while 0 < at < len(text):
            if text[at - 1 : at + 1] not in self.pairs:
                return at
            at += step
        return -1

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Best score from each entry to each exit of a chunk of ``n`` characters, ``text`` being
        the chunk and what a last piece may reach of the next one."""
        width = self.width
        out = np.full((width, width), NONE, np.int64)

        def ends(start: int, score: int, begin: int) -> np.ndarray:
            best, _ = self.forward(text[begin:], [NONE] * (start - begin) + [score], n - begin)
            row = [x if x > NONE else NONE for x in best[n - begin : n - begin + width]]
            return np.array(row + [NONE] * (width - len(row)), np.int64)

        inner = self.inner(text, n)
        if inner is None:
            for i in range(min(width, n + 1)):
                out[i] = ends(i, 0, 0)
            return out
        # What lies between the two adds the same to every path, and only differences matter.
        first, last = inner
        tail = ends(last, 0, last)
        for i in range(width):
            best, _ = self.forward(text[:first], [NONE] * i + [0], first)
            if best[first] > NONE:
                out[i] = np.where(tail > NONE, tail + best[first], NONE)
        return out

    def inner(self, text: str, n: int) -> tuple[int, int] | None:
        """The first and the last place inside a chunk that every path passes, clear of its ends."""
        first, last = self.cut(text, self.width, 1), self.cut(text, n - self.width, -1)
        return (first, last) if 0 <= first <= last < n else None

    def entered(self, text: str, n: int, entry: list[int]) -> list[int]:
        """For each exit the state in which the best path to it enters the chunk, -1 without one."""
        inner = self.inner(text, n)
        exits = range(n, min(n + self.width, len(text) + 1))
        if inner is None:
            best, back = self.forward(text, entry, n)
            return [self.backward(text, back, e)[0] if best[e] > NONE else -1 for e in exits]
        first, last = inner
        _, back = self.forward(text[:first], entry, first)
        start = self.backward(text[:first], back, first)[0]
        best, _ = self.forward(text[last:], [0], n - last)
        return [start if best[e - last] > NONE else -1 for e in exits]

    def traced(self, text: str, n: int, entry: list[int], leave: int) -> list[int]:
        """Ids of the best path through a chunk that leaves it in a known state."""
        inner = self.inner(text, n)
        if inner is None:
            _, back = self.forward(text, entry, n)
            return self.backward(text, back, n + leave)[1]
        first, last = inner
        _, head = self.forward(text[:first], entry, first)
        _, tail = self.forward(text[last:], [0], n - last)
        return [
            *self.backward(text[:first], head, first)[1],
            *self.stretch(text[first:last]),
            *self.backward(text[last:], tail, n - last + leave)[1],
        ]


def surfaces_of(vocabulary: list[tuple[str, float, str]]) -> list[bytes]:
    """What each id stands for in a text."""
    make = {
        "piece": lambda piece: piece.replace(SPACE, " ").encode(),
        "byte": lambda piece: bytes([int(piece[3:5], 16)]), "control": lambda piece: b"",
    }
    return [make[kind](piece) for piece, _, kind in vocabulary]


def decoded(surfaces: list[bytes], ids) -> str:
    """The text of ids made by ``encode``; the leading space that encoding adds goes."""
    return b"".join([surfaces[i] for i in ids])[1:].decode()


def parts_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Start and end of the texts that are encoded at a time."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHARACTERS):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def prepared(text: str, first: bool) -> str:
    """The text as the vocabulary sees it: spaces as their mark, one more at the very start."""
    marked = text.replace(SPACE, LITERAL).replace(" ", SPACE)
    return SPACE + marked if first and text else marked


def scan(matrices: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Entry scores of each chunk: the max-plus product of the matrices before it, up to a constant
    (only differences matter, and taking the largest off keeps numbers small)."""
    at = np.full(width, NONE, np.int64)
    at[0] = 0
    out = []
    for m in matrices:
        out.append(at)
        both = np.where((at[:, None] > NONE) & (m > NONE), at[:, None] + m, NONE).max(axis=0)
        at = np.where(both > NONE, both - both.max(), NONE)
    return out


@lru_cache(maxsize=2)
def _lattice_of(key: str, holder: _Held) -> Lattice:
    return Lattice(holder.value)


class _Held:
    """A broadcast vocabulary; equal keys mean equal vocabularies."""

    def __init__(self, value) -> None:
        self.value = value

    def __eq__(self, other) -> bool:
        return True

    def __hash__(self) -> int:
        return 0


class Pieces:
    """Encoder and decoder for one vocabulary, whose file only the driver reads. The vocabulary is
    broadcast: its size is the model's and does not grow with the data."""

    def __init__(self, spark: SparkSession, model: str = MODEL, chunk: int = CHUNK) -> None:
        vocabulary = load_vocabulary(model)
        self.shared = spark.sparkContext.broadcast(vocabulary)
        self.key = f"{model}:{hash(tuple(vocabulary))}"
        self.width = max(len(p) for p, _, kind in vocabulary if kind == "piece")
        self.chunk = max(chunk, 2 * self.width)

    def _get(self):
        shared, key = self.shared, self.key
        return lambda: _lattice_of(key, _Held(shared.value))

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` plus the column ``ids``, which replaces one of that name.

        Null text is empty, and the empty text has no ids; repeated rows are rows of their own; an
        empty table stays empty; other columns pass through.
        """
        get, docs = self._get(), docs.drop(ids)
        giant = F.length(text_or_empty(text)) > 2 * self.chunk
        schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = get()
            for batch in batches:
                texts = [t or "" for t in batch.column(text).to_pylist()]
                for start, end in parts_of(texts):
                    found = lattice.encode_all(texts[start:end])
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(found, pa.list_(pa.int32()))],
                        [*part.schema.names, ids],
                    )

        small = docs.where(~giant).mapInArrow(run, schema)
        numbered = stored(docs.where(giant).withColumn("__row", F.monotonically_increasing_id()))
        made = self._encode_giants(numbered.select(F.col("__row").alias("row"), F.col(text).alias("text")))
        large = numbered.join(made.toDF("__row", ids), "__row").select(*docs.columns, ids)
        return small.unionByName(large)

    def _encode_giants(self, docs: DataFrame) -> DataFrame:
        get, size, width = self._get(), self.chunk, self.width

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                    whole = text.as_py()
                    count = max(1, len(whole) // size)
                    for c in range(count):
                        end = (c + 1) * size if c + 1 < count else len(whole)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "row": [row], "c": [c],
                                "text": [whole[c * size : end]],
                                "ahead": [whole[end : end + width - 1]],
                            },
                            schema=schema,
                        )

        schema = pa.schema(
            [("row", pa.int64()), ("c", pa.int32()), ("text", pa.string()), ("ahead", pa.string())]
        )
        chunks = stored(docs.mapInArrow(split, "row long, c int, text string, ahead string"))

        def ready(batch: pa.RecordBatch, i: int) -> tuple[str, int]:
            body = prepared(batch.column("text")[i].as_py(), batch.column("c")[i].as_py() == 0)
            return body + prepared(batch.column("ahead")[i].as_py(), False), len(body)

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = get()
            for batch in batches:
                made = [lattice.transfer(*ready(batch, i)).tobytes() for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("c"), pa.array(made, pa.binary())],
                    ["row", "c", "matrix"],
                )

        def entries(part):
            import pandas as pd

            part = part.sort_values("c")
            made = [np.frombuffer(m, np.int64).reshape(width, width) for m in part["matrix"]]
            return pd.DataFrame(
                {
                    "row": part["row"], "c": part["c"],
                    "entry": [x.tobytes() for x in scan(made, width)],
                }
            )

        transferred = chunks.mapInArrow(matrices, "row long, c int, matrix binary")
        entered = transferred.groupBy("row").applyInPandas(entries, "row long, c int, entry binary")
        placed = stored(chunks.join(entered, ["row", "c"]))

        def entry_of(batch: pa.RecordBatch, i: int) -> list[int]:
            return np.frombuffer(batch.column("entry")[i].as_buffer(), np.int64).tolist()

        def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = get()
            for batch in batches:
                found = [
                    lattice.entered(*ready(batch, i), entry_of(batch, i)) for i in range(len(batch))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("c"), pa.array(found, pa.list_(pa.int32()))],
                    ["row", "c", "entered"],
                )

        def exits(part):
            import pandas as pd

            part = part.sort_values("c")
            out, state = [], 0
            for entered in reversed(list(part["entered"])):
                out.append(state)
                state = int(entered[state])
            return pd.DataFrame({"row": part["row"], "c": part["c"], "leave": out[::-1]})

        left = (
            placed.mapInArrow(maps, "row long, c int, entered array<int>")
            .groupBy("row")
            .applyInPandas(exits, "row long, c int, leave int")
        )

        def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = get()
            for batch in batches:
                leave = batch.column("leave").to_pylist()
                texts = [ready(batch, i) for i in range(len(batch))]
                for start, end in parts_of([text for text, _ in texts]):
                    lattice.prepare_chunks([text for text, _ in texts[start:end]])
                    found = [
                        lattice.traced(*texts[i], entry_of(batch, i), leave[i])
                        for i in range(start, end)
                    ]
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("c"), pa.array(found, pa.list_(pa.int32()))],
                        ["row", "c", "ids"],
                    )

        parts = placed.join(left, ["row", "c"]).mapInArrow(backtrace, "row long, c int, ids array<int>")
        gathered = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "ids"))).alias("x"))
        return gathered.select("row", F.flatten(F.col("x.ids")).alias("ids"))

    def decode(self, encoded: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """``encoded`` plus the texts of its ``ids`` in the column ``text``, which replaces one of
        that name. Null ids give the empty text."""
        shared, encoded = self.shared, encoded.drop(text)
        schema = StructType([*encoded.schema.fields, StructField(text, StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            surfaces = surfaces_of(shared.value)
            for batch in batches:
                column = batch.column(ids)
                texts = [
                    decoded(surfaces, column[i].values.to_numpy(zero_copy_only=False).tolist())
                    if column[i].is_valid
                    else ""
                    for i in range(len(column))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text]
                )

        return encoded.mapInArrow(run, schema)


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of ``docs`` and their ``ids``."""
    return Pieces(docs.sparkSession, model).encode(docs)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = Pieces(spark)
    back = pieces.decode(pieces.encode(docs))
    text, decoded = text_or_empty("text"), F.col("decoded")
    return back.select(
        "doc_id", F.length(text).cast("bigint").alias("n_chars"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        hex_sha256(F.array_join("ids", " ")).alias("ids_sha256"),
        hex_sha256(decoded).alias("decoded_sha256"), (decoded == text).alias("exact"),
    )
