"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every training text is cut into passages of W words that overlap by half, W being twice
the longest item, so that a copied item lies whole in some passage. Each passage is a
query. A posting holds an item's BM25 weight for a term as a share of the item's greatest
possible score, so one threshold serves items of any length. The search keeps a cursor
per term, finds the pivot by term bounds, checks it by block bounds and scores or
skips. Passages that miss too much of every item's rarest terms cannot reach the
threshold and never become queries (the same bound, taken on whole batches).

Retrieved items are verified by shares of word 5-grams: of the whole item, of its
question and of its answer. A text is contaminated by an item if the whole item, or
both question and answer, are there to OVERLAP or more.

Items are dealt into shards of at most SHARD_BYTES of text (or one item); every shard is
one broadcast index with its own statistics, and the texts are read once per shard.

Defined cases: null or blank items and texts match nothing; an item of fewer than five
words is verified by its whole sequence; equal items are all reported; repeated rows are
reported each; null ids are reported as null; an empty table gives an empty result;
extra columns are kept by ``clean``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches
from lexspark.llm.words import chunks, split_words, text_buffer

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, GRAM = 0.6, 0.8, 5
BLOCK = 16
SHARD_BYTES = 1 << 20
RARE_MASS = 0.7
_SPACE = r"[\x20\x09-\x0D]"


def _hashes(text: str) -> np.ndarray:
    data = text.encode()
    return split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes


def question_and_answer(text: str) -> tuple[str, str]:
    """The question ends with the first question mark, else line, else sentence; the rest is the answer."""
    for mark in (r"\?", r"\n", rf"[.!]{_SPACE}"):
        found = re.search(mark, text)
        if found and text[found.end() :].strip():
            return text[: found.end()], text[found.end() :]
    return text, ""


def _grams(words: np.ndarray) -> set[tuple]:
    w = words.tolist()
    return {tuple(w[i : i + GRAM]) for i in range(max(1, len(w) - GRAM + 1))} if w else set()


class Index:
    """Postings of one shard, in blocks with their greatest weights."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        for item_id, text in items:
            words = _hashes(text)
            if len(words):
                q, a = question_and_answer(text)
                self.items.append((item_id, words, _grams(words), _grams(_hashes(q)), _grams(_hashes(a))))
        lengths = np.array([len(x[1]) for x in self.items] or [1])
        self.window = 2 * int(lengths.max())
        df = Counter(t for x in self.items for t in set(x[1].tolist()))
        n, mean = len(self.items), lengths.mean()
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        rare: list[tuple[int, int, float]] = []
        self.rare_need = np.zeros(n)
        for i, (_, words, *_rest) in enumerate(self.items):
            tf = Counter(words.tolist())
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            greatest, mass = sum(weight.values()), 0.0
            for t in sorted(weight, key=lambda t: (df[t], t)):
                share = weight[t] / greatest
                postings[t].append((i, share))
                if mass < RARE_MASS:
                    rare.append((t, i, share))
                    mass += share
            # a passage with less than this from the item's rarest terms is below the threshold
            self.rare_need[i] = THRESHOLD - (1 - mass) - 1e-9
        self.postings = {}
        for t, p in postings.items():
            ids, shares = [i for i, _ in p], [s for _, s in p]
            self.postings[t] = (ids, shares, [max(shares[k : k + BLOCK]) for k in range(0, len(shares), BLOCK)], max(shares))
        rare.sort()
        self.rare_terms, self.rare_first = np.unique(np.array([t for t, _, _ in rare], np.uint64), return_index=True)
        self.rare_first = np.append(self.rare_first, len(rare))
        self.rare_items = np.array([i for _, i, _ in rare], np.int64)
        self.rare_shares = np.array([s for _, _, s in rare])

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score for the terms is at least the threshold, by block-max WAND."""
        # a cursor: its item, its place, its list
        cursors = [[p[0][0], 0, p] for t in terms if (p := self.postings.get(t))]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            group = cursors[: pivot + 1]
            # block bounds at the pivot item
            blocks, ends = 0.0, []
            for ids, _, tops, _ in (c[2] for c in group):
                k = bisect_left(ids, item) // BLOCK
                if k < len(tops):
                    blocks += tops[k]
                    ends.append(ids[min((k + 1) * BLOCK, len(ids)) - 1])
            if blocks < threshold:
                # no item up to the end of the nearest block, or up to the next cursor, can do it
                target = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]], default=item + 1)
            elif group[0][0] == item:
                score = sum(c[2][1][c[1]] for c in group)
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            moved = []
            for c in group:
                ids = c[2][0]
                at = bisect_left(ids, target, c[1])
                if at < len(ids):
                    moved.append([ids[at], at, c[2]])
            cursors = moved + cursors[pivot + 1 :]
        return found


def _share(part: set[tuple], words: np.ndarray) -> float:
    """Share of a part's grams that a run of words has."""
    if not part:
        return 1.0
    size = len(next(iter(part)))
    w = words.tolist()
    have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return len(part & have) / len(part)


def hits(index: Index, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
    """Row, item, score and overlaps (whole, question, answer) of the verified leaks of a batch, best passage each."""
    out = []
    if not index.items:
        return out
    step, n_items = index.window // 2, len(index.items)
    data, offsets = text_buffer(texts)
    for at, end in chunks(offsets):
        words = split_words(data, offsets[at : end + 1])
        if not len(words.hashes):
            continue
        i = np.minimum(np.searchsorted(index.rare_terms, words.hashes), len(index.rare_terms) - 1)
        where = np.flatnonzero(index.rare_terms[i] == words.hashes)
        if not len(where):
            continue
        count = np.diff(index.rare_first)[i[where]]
        posting = np.repeat(index.rare_first[i[where]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where = np.repeat(where, count)
        row = np.searchsorted(words.first, where, "right") - 1
        # passage k of a text holds its words from k * step on; a word lies in passages k and k - 1
        passage = (where - words.first[row]) // step
        keys = []
        width = int(passage.max()) + 2
        for back in (0, 1):
            keys.append(((row * width + passage + 1 - back) * n_items + index.rare_items[posting]) * len(index.rare_items) + posting)
        key = np.unique(np.concatenate(keys))  # a term counts once per passage and item
        pair, posting = key // len(index.rare_items), key % len(index.rare_items)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        mass = np.add.reduceat(index.rare_shares[posting], first)
        good = first[mass >= index.rare_need[pair[first] % n_items]]
        best: dict[tuple[int, int], tuple] = {}
        for place in np.unique(pair[good] // n_items).tolist():
            r, k = divmod(place, width)
            start = words.first[r] + max(k - 1, 0) * step
            passage_words = words.hashes[start : min(start + index.window, words.first[r + 1])]
            for item, score in index.search(set(passage_words.tolist()), THRESHOLD):
                _, _, whole, question, answer = index.items[item]
                shares = tuple(_share(x, passage_words) for x in (whole, question, answer))
                sure = shares[0] >= OVERLAP or min(shares[1:]) >= OVERLAP
                if sure and (shares[0], score) > best.get((r, item), (-1.0,))[:2]:
                    best[r, item] = (shares[0], score, *shares[1:])
        out += [(at + r, item, s[1], s[0], s[2], s[3]) for (r, item), s in sorted(best.items())]
    return out


def shards(benchmark: DataFrame):
    """Indexes of the test items, one after another; each is of bounded size."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = F.octet_length("text")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // SHARD_BYTES)) if total > SHARD_BYTES else 1
    while total:
        dealt = items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("shard")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if dealt.where((F.col("bytes") > SHARD_BYTES) & (F.col("n") > 1)).isEmpty() or n > total:
            break
        n *= 2
    for k in range(n if total else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part.collect()))


def _finder(shared):
    def find(batches: Batches) -> Batches:
        index = shared.value
        for batch in batches:
            rows = hits(index, batch.column("text"))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([r[0] for r in rows])), pa.array([index.items[r[1]][0] for r in rows], pa.int64()),
                    *[pa.array([float(r[k]) for r in rows]) for k in (2, 3, 4, 5)],
                ], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return find


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that it contains."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in shards(benchmark):
        found = documents.select("doc_id", "text").mapInArrow(_finder(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    for index in shards(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Batches, shared=shared) -> Batches:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[r[0] for r in hits(shared.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(good))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
