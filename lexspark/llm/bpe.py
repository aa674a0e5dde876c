"""Token counts: byte-pair merging with a heap and a linked list.

A text is cut at the special strings of the vocabulary file (one token each) and
by the pre-token pattern. Each pre-token starts as its bytes; the lowest-ranked
adjacent pair is popped from a heap and merged in a doubly linked list until none
is left. The count is bytes minus merges; no identifiers are made. Counts of
pre-tokens are remembered, up to CACHE entries, then forgotten and begun again.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens; a lone
surrogate cannot occur in a string column; a null id and repeated rows give one
result row each; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches

# Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
LIMIT = 512


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merge ranks of a vocabulary file, and the counts of the pre-tokens met so far."""

    def __init__(self, content: str):
        file = json.loads(content)
        ids = file["model"]["vocab"]
        self.first = [ids.get(s) for s in _byte_symbols()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        special = sorted((t["content"] for t in file.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token."""
        symbols = [self.first[b] for b in piece.encode()]
        count = n = len(symbols)
        if n < 2:
            return n
        ranks = self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*ranks[pair], i, *pair) for i in range(n - 1) if (pair := (symbols[i], symbols[i + 1])) in ranks]
        heapq.heapify(heap)
        # a heap entry: rank, merged symbol, place, and the two symbols it was made for
        while heap:
            _, joined, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                pair = (joined, symbols[k])
                if pair in ranks:
                    heapq.heappush(heap, (*ranks[pair], i, *pair))
            if (h := before[i]) >= 0:
                pair = (symbols[h], joined)
                if pair in ranks:
                    heapq.heappush(heap, (*ranks[pair], h, *pair))
        return count

    def count(self, text: str) -> int:
        """Tokens of a text."""
        known, total = self.known, 0
        if self.special and self.special.search(text):
            total = len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            for piece in self.pattern.findall(part):
                c = known.get(piece)
                if c is None:
                    if len(known) >= CACHE:
                        known.clear()
                    c = self.merged(piece)
                    if len(piece) <= 64:
                        known[piece] = c
                total += c
        return total


_LOADED: dict[str, Vocabulary] = {}  # of this Python worker, by the file's digest


def _counter(content, digest: str):
    def count(batches: Batches) -> Batches:
        if digest not in _LOADED:
            _LOADED[digest] = Vocabulary(content.value)
        vocabulary = _LOADED[digest]
        for batch in batches:
            texts = batch.column("text")
            counts = [vocabulary.count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return count


def token_counts(documents: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    The vocabulary file is broadcast; its size does not depend on the documents.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    shared, digest = documents.sparkSession.sparkContext.broadcast(content), hashlib.sha1(content.encode()).hexdigest()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    counted = documents.select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    ).mapInArrow(_counter(shared, digest), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
