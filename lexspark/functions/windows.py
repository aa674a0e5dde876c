"""Keys on which short similar texts meet: subsequences of a window at one end, hashed in Arrow batches.

Let two texts be at most E edits apart, and take the last (or first) W characters of both. What
stands in one window and is lost in the other costs an edit each, also where an edit moves the
window, so the windows have a common subsequence of W - E characters. If they have none that is
longer, all edits are in the window and the rest of the texts is equal. So a pair meets on a
common subsequence of W - E + 1 characters, or on one of W - E and the characters at the far end.
No place has to be guessed, and windows that hold nothing but a rare word tell as many texts apart
as its characters do, less E.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa

# texts of which some similar one has more edits have too many subsequences
MOST_EDITS = 3
# characters of a window that no edit takes away, and most characters of the far end
KEPT, FAR = 6, 8
HEAD, TAIL = 0, 1
# sizes of one band have windows of one width
BAND = 10
# texts that are worked on together
ROWS = 2_000
# so many characters of a word stand for the word
ENOUGH = 6
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache
def allowed_edits(longer: int, threshold: float) -> int:
    return math.floor(longer * (1.0 - threshold) + 1e-9)


def similar_sizes(size: int, threshold: float) -> range:
    """The lengths a similar text may have."""
    return range(math.ceil(size * threshold - 1e-9), math.floor(size / threshold + 1e-9) + 1)


@lru_cache
def is_short(size: int, threshold: float) -> bool:
    return allowed_edits(similar_sizes(size, threshold)[-1], threshold) <= MOST_EDITS


def longest_short(threshold: float) -> int:
    size = 0
    while is_short(size + 1, threshold):
        size += 1
    return size


@lru_cache
def _kind(edits: int, band: int, threshold: float) -> tuple[int, int, int]:
    """(edits, width, far) of the right texts of a band that may have so many edits: no text is shorter than the two together."""
    least = min(
        s for s in range(max(1, band * BAND), (band + 1) * BAND)
        if any(allowed_edits(max(s, n), threshold) == edits for n in similar_sizes(s, threshold))
    )
    width = min(KEPT + edits, least)
    return edits, width, min(least - width, FAR)


def kinds_of_right(size: int, lefts: Iterable[int], threshold: float) -> set[tuple[int, int, int]]:
    """The kinds on which a text of this size meets left texts of these lengths."""
    near = set(similar_sizes(size, threshold)).intersection(lefts)
    return {_kind(allowed_edits(max(size, n), threshold), size // BAND, threshold) for n in near}


def kinds_of_left(size: int, rights: Iterable[tuple[int, int]], threshold: float) -> set[tuple[int, int, int, int]]:
    """As ``kinds_of_right``, with the place, for right texts of these (size, place)."""
    near = similar_sizes(size, threshold)
    return {(*_kind(allowed_edits(max(size, s), threshold), s // BAND, threshold), place) for s, place in rights if s in near}


def _sets(kind: tuple[int, int, int], held: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(family, far, places kept) for a window that has ``held`` characters."""
    edits, width, far = kind
    families = [(1, 0, width - edits + 1), (2, far, width - edits)] if edits else [(2, far, width)]
    for family, end, kept in families:
        for places in combinations(range(held), kept):
            yield family, end, places


def key_count(kind: tuple[int, int, int], size: int) -> int:
    return sum(1 for _ in _sets(kind, min(kind[1], size)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def window_keys(codes: np.ndarray, kinds: Iterable[tuple[int, int, int, int]]) -> np.ndarray:
    """Keys of the texts whose code points are the rows of ``codes``: one column a text, sorted."""
    size, columns = codes.shape[1], codes.T.astype(np.uint64)
    keys = []
    with np.errstate(over="ignore"):
        for edits, width, far, place in sorted(kinds):
            held = min(width, size)
            window = columns[size - held:] if place == TAIL else columns[:held]
            powered = {}
            for family, end, places in _sets((edits, width, far), held):
                seed = np.uint64(((((family * 64 + edits) * 64 + width) * 64 + end) * 2 + place) * 2 + 1)
                if (family, end) not in powered:
                    # the far end of a text that is shorter than it is no longer text's
                    start = columns[:end] if place == TAIL else columns[max(size - end, 0):]
                    h = np.full(codes.shape[0], seed * _P, np.uint64)
                    for c in start:
                        h = _mixed((h + c + np.uint64(1)) * _P)
                    powered[family, end] = h
                h = powered[family, end]
                for at in places:
                    h = h * _P + window[at] + np.uint64(1)
                keys.append(_mixed(_mixed(h)))
    return np.sort(np.stack(keys), axis=0) if keys else np.empty((0, codes.shape[0]), np.uint64)


def code_points(texts: list[str], size: int) -> np.ndarray:
    return np.array(texts, dtype=f"U{size}").view(np.uint32).reshape(len(texts), size)


def keyed_texts(kinds: Mapping[tuple[int, int], set[tuple[int, int, int, int]]], wave: int, waves: int):
    """Arrow batches of (text, size, place) to (key, text), for the keys of one wave; ``kinds`` by (size, place)."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], list[str]] = {}
            for text, size, place in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "place")), strict=True):
                groups.setdefault((size, place), []).append(text)
            for (size, place), texts in groups.items():
                for start in range(0, len(texts), ROWS):
                    part = texts[start : start + ROWS]
                    keys = window_keys(code_points(part, size), kinds.get((size, place), ()))
                    if not len(keys):
                        continue
                    # the same subsequence twice in a text is one key
                    wanted = np.ones(keys.shape, bool)
                    wanted[1:] = keys[1:] != keys[:-1]
                    if waves > 1:
                        wanted &= (keys >> np.uint64(40)) % np.uint64(waves) == np.uint64(wave)
                    _, owner = np.nonzero(wanted)
                    found = pa.array(keys[wanted].view(np.int64), pa.int64())
                    yield pa.RecordBatch.from_arrays([found, pa.array(part).take(pa.array(owner))], ["key", "text"])

    return keyed


def placed_texts(common: Mapping[str, int], n: int, threshold: float):
    """Arrow batches of texts to (text, size, place): at which end a short text is rare enough, NULL for any other.

    ``common`` has the texts of the frequent words; a part of a word counts like the word from ENOUGH characters on.
    """
    whole = math.log2(n + 1.0)
    weights = {word: math.log2((n + 1.0) / df) for word, df in common.items()}

    def rarity(words: list[str], width: int) -> float:
        found, left = 0.0, width
        for word in words:
            if left <= 0:
                break
            if word:
                found += weights.get(word, whole) * min(1.0, min(left, len(word)) / min(len(word), ENOUGH))
            left -= len(word) + 1
        return found

    def place(text: str) -> int | None:
        if not is_short(len(text), threshold):
            return None
        words, width = text.split(" "), KEPT + allowed_edits(len(text), threshold)
        head, tail = rarity(words, width), rarity(words[::-1], width)
        return None if max(head, tail) < whole / 2 else HEAD if head > tail else TAIL

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32()), pa.array([place(t) for t in texts], pa.int32()),
            ], ["text", "size", "place"])

    return placed
