"""Packing documents into sequences by patterns fitted to the length histogram.

All texts become pieces of at most ``capacity`` tokens (the first piece of a longer
document is the shorter one). What is planned is the histogram of piece lengths, whose
size does not depend on the documents: patterns are pairs and triples of lengths that fill a
sequence exactly, their repeat counts are fitted to the histogram by non-negative least
squares (multiplicative steps, long pieces weighing more), rounded down to what is there,
and the pieces left over are packed by best fit on counts, longest first. Full pieces
are sequences by themselves. The plan is a table of slots (length, from which rank on,
how many, sequence, offset); it goes to every task, has at most three slots for
each exact pattern (some capacity^2 / 12 triples) and is otherwise as long as the
patterns of the rest.

A piece finds its slot by its rank among the pieces of its length: its place among those
of its own task, noted while the texts are read, plus the counts of the tasks before. So
no length, however common, is gathered in one task. Texts are tokenised once; the pieces
(no texts) go to the checkpoint folder.

Defined cases: a null or empty text is one piece with the closing id alone; a null id is
carried as null; repeated rows are packed one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm.bpe import PATTERN, _byte_symbols
from lexspark.llm.common import Batches
from lexspark.session import cut_lineage

CAPACITY = 2048
CLOSING_ID = 0
STEPS = 100
RANK_BITS = 44


class Encoder:
    """Token ids of texts as the tokenizer library gives them.

    A plain byte-level file whose merges stand in the order of their ids is read into the
    faster of two libraries, which gives the same ids; texts it refuses, and other files,
    go to the tokenizer library itself.
    """

    def __init__(self, content: str):
        self.whole = Tokenizer.from_str(content)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.fast = self._fast(json.loads(content))

    @staticmethod
    def _fast(file: dict) -> tiktoken.Encoding | None:
        model, added = file["model"], file.get("added_tokens", [])
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        before = file.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(file.get(k) for k in ("normalizer", "truncation", "padding")) and not any(t.get(f) for t in added for f in flags)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        )
        if not plain:
            return None
        special = {t["content"]: t["id"] for t in added}
        symbol = {s: b for b, s in enumerate(_byte_symbols())}
        ids = {s: i for s, i in model["vocab"].items() if s not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [ids.get(a + b, -1) for a, b in pairs]
        if made != sorted(set(made)) or len(ids) != 256 + len(made) or any(c not in symbol for s in ids for c in s):
            return None
        ranks = {bytes(symbol[c] for c in s): i for s, i in ids.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern matcher gives up on very long runs of white space
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, Encoder] = {}  # of this Python worker, by the file's digest


def _pieces(content, digest: str, capacity: int):
    """Pieces of every document, each with its rank among the pieces of its length in this task."""

    def pieces(batches: Batches) -> Batches:
        if digest not in _LOADED:
            _LOADED[digest] = Encoder(content.value)
        encoder, part, met = _LOADED[digest], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), CLOSING_ID).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), int(met[b - a])))
                    met[b - a] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *columns, pa.array([part] * len(rows), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "place", "part"],
            )

    return pieces


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of the given lengths that fill a sequence; rows of three, 0 for no third."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found = []
    for a in np.flatnonzero(have[: capacity // 2 + 1]):
        if have[capacity - a]:
            found.append([[a, capacity - a, 0]])
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[have[b] & have[capacity - a - b]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts whose pieces come closest to the histogram in weighted squares."""
    size = len(histogram)
    weight = np.arange(size) / size
    weight[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=size)
        total[0] = 0
        return total

    degree = np.maximum(used(np.ones(len(patterns))), 1)
    share = histogram / degree
    share[0] = np.inf
    x = share[patterns].min(1)
    wish = (weight * histogram)[patterns].sum(1)
    for _ in range(steps):
        x = x * wish / np.maximum((weight * used(x))[patterns].sum(1), 1e-300)
    return x


def _round(patterns: np.ndarray, fitted: np.ndarray, left: np.ndarray, exhaust: bool) -> list[tuple[tuple, int]]:
    """Whole repeat counts within what is there, best fitted first; ``left`` loses what they take."""
    taken: dict[int, int] = {}
    order = np.argsort(-fitted, kind="stable")
    for full in (False, True) if exhaust else (False,):
        able = (left[patterns[order]] > 0) | (patterns[order] == 0)
        for p in order[able.all(1)]:
            parts = [int(a) for a in patterns[p] if a]
            there = min(left[a] // parts.count(a) for a in parts)
            n = int(there if full else min(there, fitted[p] + 0.5))
            if n:
                taken[p] = taken.get(p, 0) + n
                for a in parts:
                    left[a] -= n
    return [(tuple(int(a) for a in patterns[p][::-1] if a), n) for p, n in taken.items()]


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit, longest first, on counts: alike sequences are one entry (lengths, how many)."""
    by_space: dict[int, list[tuple[tuple, int]]] = {}
    spaces = 0  # a bit for each space that some open sequence has
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            fits = spaces >> length
            if fits:
                space = length + (fits & -fits).bit_length() - 1
                lengths, many = by_space[space].pop()
            else:
                space, lengths, many = capacity, (), n
            each = space // length
            sequences, rest = min(many, n // each), 0
            if sequences < many and n - sequences * each:
                rest = n - sequences * each
            opened = [(lengths + (length,) * each, sequences, space - each * length), (lengths + (length,) * rest, 1 if rest else 0, space - rest * length)]
            if lengths:
                opened.append((lengths, many - sequences - (1 if rest else 0), space))
            n -= sequences * each + rest
            if not by_space.get(space):
                spaces &= ~(1 << space)
            for own, count, free in opened:
                if count:
                    by_space.setdefault(free, []).append((own, count))
                    spaces |= 1 << free
    return [entry for entries in by_space.values() for entry in entries]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Patterns (lengths in their order) and repeat counts that use every piece of the histogram exactly once."""
    histogram = histogram.astype(np.int64)
    full = [((capacity,), int(histogram[capacity]))] if histogram[capacity] else []
    rest = histogram.copy()
    rest[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(rest), capacity)
    fitted = fit_counts(patterns, rest[:capacity]) if len(patterns) else np.zeros(0)
    best = None
    # what the rounding leaves is packed either at once or after all exact patterns are used up
    for exhaust in (False, True):
        left = rest.copy()
        tried = _round(patterns, fitted, left, exhaust)
        tried += best_fit(left, capacity)
        if best is None or sum(n for _, n in tried) < sum(n for _, n in best):
            best = tried
    return full + best


def _slots(patterns: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Slots by length and rank: key, first rank, first sequence, offset."""
    slots, sequence, rank = array("q"), 0, {}
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            first = rank.get(length, 0)
            slots.extend(((length << RANK_BITS) + first, first, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    table = np.frombuffer(slots, np.int64).reshape(-1, 4)
    order = np.argsort(table[:, 0], kind="stable")
    return tuple(table[order, i] for i in range(4))


def _placed(shared):
    def placed(batches: Batches) -> Batches:
        key, first, sequence, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = np.searchsorted(key, (length << RANK_BITS) + rank, "right") - 1
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence[slot] + rank - first[slot]), pa.array(offset[slot])], [*kept, "sequence_id", "offset"]
            )

    return placed


def pack(documents: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of ``documents`` (doc_id, text)."""
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    spark = documents.sparkSession
    shared, digest = spark.sparkContext.broadcast(content), hashlib.sha1(content.encode()).hexdigest()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    kept = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = cut_lineage(documents.select("doc_id", "text").mapInArrow(_pieces(shared, digest, capacity), f"{kept}, place bigint, part int"))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most one row for each length
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("place") + F.col("base"))
    return ranked.mapInArrow(_placed(slots), f"{kept}, sequence_id bigint, offset bigint")
