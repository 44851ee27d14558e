"""Differences of two texts by a longest common subsequence of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Words of both texts together beyond which they are compared by lines.
MOST_WORDS = 10_000


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """The length of a longest common subsequence of a and b[:j], for j = 0, 1, ... len(b).

    A row of the table of lengths rises by one or not at all from place to place: the places where it doesn't are the bits
    of one long number, and a word of a changes them all by an addition."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    flat = all_
    for x in a:
        if hit := flat & places.get(x, 0):
            flat = ((flat + hit) | (flat - hit)) & all_
    bits = np.unpackbits(np.frombuffer(flat.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence, in memory that is linear in both.

    a is halved; where b has to be cut for that, the lengths before and behind tell; then each half by itself."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            at = next((x for x in range(j, m) if b[x] == a[i]), None)
            if at is not None:
                out.append((i, at))
            continue
        half = (i + k) // 2
        before, behind = _lengths(a[i:half], b[j:m]), _lengths(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(np.argmax(before + behind))
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def runs(old: str, new: str, most_words: int = MOST_WORDS) -> Iterator[tuple[str, str]]:
    """kind (same, remove, add) and text of each run of words, or of lines if there are too many words."""
    words = len(old.split()) + len(new.split()) <= most_words
    x, y = (t.split() if words else t.split("\n") if t else [] for t in (old, new))
    number: dict[str, int] = {}
    a, b = ([number.setdefault(w, len(number)) for w in side] for side in (x, y))
    made: list[tuple[str, list[str]]] = []

    def add(kind: str, part: list[str]) -> None:
        if part and made and made[-1][0] == kind:
            made[-1][1].extend(part)
        elif part:
            made.append((kind, list(part)))

    i = j = 0
    for at, bt in [*common(a, b), (len(x), len(y))]:
        add("remove", x[i:at])
        add("add", y[j:bt])
        add("same", x[at : at + 1])
        i, j = at + 1, bt + 1
    yield from ((kind, (" " if words else "\n").join(part)) for kind, part in made)


def word_diff(pairs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """pairs (id, old, new) as id, ix, kind (same, remove, add), text: the runs of a longest common subsequence of words; by
    lines where both texts have more than most_words words together. What is removed comes before what is added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, kind, text) for d, old, new in zip(b["id"], b["old"], b["new"], strict=True) for i, (kind, text) in enumerate(runs(old or "", new or "", most_words))]
            yield pd.DataFrame(rows, columns=["id", "ix", "kind", "text"])

    return pairs.select("id", "old", "new").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, ix int, kind string, text string")
