"""Sorted runs of byte strings: front coding, and merging that knows common prefixes.

A run is a sorted list of strings, each stored as the length of the prefix it shares with the one
before it and the rest. Runs are merged by a tree of losers in which every contender carries the
length of the prefix it shares with the last winner: the longer one wins without a look at the
bytes, and equal ones are compared from that length on. So no byte of a known prefix is compared
again, and the merge yields the common prefixes of its output for free.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

Entry = tuple[int, bytes, int]  # common prefix with the entry before, string, payload


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    end = min(len(a), len(b))
    step = 64
    while start + step <= end and a[start : start + step] == b[start : start + step]:
        start += step
    while step > 1:
        step //= 2
        if start + step <= end and a[start : start + step] == b[start : start + step]:
            start += step
    return start + 1 if start < end and a[start] == b[start] else start


def make_run(rows: Sequence[tuple[bytes, int]]) -> list[Entry]:
    out: list[Entry] = []
    last = b""
    for text, payload in sorted(rows):
        out.append((common(last, text), text, payload))
        last = text
    return out


def pack(run: Sequence[Entry]) -> bytes:
    """A front-coded run: for each entry shared and remaining length, payload, remaining bytes."""
    parts = [struct.pack("<I", len(run))]
    parts += [struct.pack("<HHQ", lcp, len(text) - lcp, payload) for lcp, text, payload in run]
    parts += [text[lcp:] for lcp, text, _ in run]
    return b"".join(parts)


def unpack(block: bytes) -> list[Entry]:
    (count,) = struct.unpack_from("<I", block)
    at, last, out = 4 + 12 * count, b"", []
    for lcp, rest, payload in struct.iter_unpack("<HHQ", memoryview(block)[4:at]):
        last = last[:lcp] + block[at : at + rest]
        at += rest
        out.append((lcp, last, payload))
    return out


def merge(runs: Sequence[Sequence[Entry]]) -> Iterator[Entry]:
    """All entries of the runs in order, each with its common prefix with the one before."""
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [iter(run) for run in runs] + [iter(()) for _ in range(k - len(runs))]
    texts: list[bytes | None] = [None] * k
    shared, payloads = [0] * k, [0] * k

    def advance(i: int) -> None:
        entry = next(feeds[i], None)
        if entry is None:
            texts[i] = None
        else:
            shared[i], texts[i], payloads[i] = entry

    def beats(a: int, b: int) -> bool:
        """Whether ``a`` wins; the loser then knows its prefix with the winner."""
        x, y = texts[a], texts[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common(x, y, shared[a])
        wins = x[n : n + 1] <= y[n : n + 1]
        shared[b if wins else a] = n
        return wins

    for i in range(k):
        advance(i)
        shared[i] = 0
    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        wins = beats(a, b)
        losers[node] = b if wins else a
        return a if wins else b

    winner = play(1)
    while texts[winner] is not None:
        yield shared[winner], texts[winner], payloads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2
