"""Vectorised hashing of the words of whole texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D (equal to the class
``[^\\x20\\x09-\\x0D]+`` over code points, since these bytes are ASCII); A-Z count
as a-z. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values() -> np.ndarray:
    raw = np.arange(256, dtype=U)
    upper = slice(ord("A"), ord("Z") + 1)
    raw[upper] += U(32)
    return mix((raw + U(1)) * U(0x9E3779B97F4A7C15))


_VALUES = _byte_values()
_STEP = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_BYTES + 1), base % 2**64, U)
        full[0] = 1
        have = _POWERS[name] = np.cumprod(full, dtype=U)
    return have[:n]


class Words(NamedTuple):
    """Words of some texts: hash and byte span of each, and the first word of each text (one entry more than texts)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each; a longer text is one range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts that ``offsets`` delimit."""
    base = int(offsets[0])
    b, off = data[base : int(offsets[-1])], offsets - base
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(off), np.int64))
    solid = ~_SPACE[b]
    border = np.zeros(n + 1, bool)
    border[off[off <= n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_VALUES[b] * _powers("up", _STEP, n), out=total[1:])
    down = _powers("down", pow(_STEP, -1, 2**64), n)
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(U) * U(0xA0761D6478BD642F)
    return Words(mix(h), starts + base, ends + base, np.searchsorted(starts, off))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles: hashes, and the start of each text's run in them (one entry more than texts).

    A text of fewer than ``size`` words has its whole sequence as one shingle, one without words has none.
    """
    first, h = words.first, words.hashes
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    factors = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(size)]
    usable = max(0, len(h) - size + 1)
    value = np.zeros(usable, U)
    for k in range(size):
        value += h[k : k + usable] * U(factors[k])
    inside = doc[:usable] == doc[size - 1 : size - 1 + usable] if usable else np.zeros(0, bool)
    value, owner = mix(value[inside]), doc[:usable][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(size - 1):
            has = count[short] > k
            whole[has] += h[first[short[has]] + k] * U(factors[k])
        value = np.concatenate([value, mix(whole ^ (count[short].astype(U) * U(0xE7037ED1A0B428DB)))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))
