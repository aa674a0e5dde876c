"""Ranked lexical search that scores equal bags of words once.

A document's score depends only on the query words it holds, how often, and on its
length number m. So every document is cut down to its vector over the items' vocabulary
(term numbers and counts, kept as bytes), documents of the same vector and m form a
class (met by hash, verified on the bytes), each class is scored once against all items,
and only the classes that win a place are expanded to members, by ascending doc_id.
An item's ten best documents lie in its ten best classes, ordered by score and least
doc_id: ten better classes hold ten better documents. The same holds for a class's ten
least members, so no more are ever gathered.

Texts are read once; the vectors go to the checkpoint folder. The vocabulary is sent to
every task, so items are taken in blocks whose texts have at most BLOCK_BYTES; the
counts of documents and terms are the same for each block. Weights and scores are exact
integers.

Defined cases: a null text, and one without a term, is no document; a null or termless
item finds nothing; rows of ``documents`` are documents, so repeated ids rank row by row;
a null doc_id comes after all others of its score; repeated items, also by id, are
answered one by one; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import Batches
from lexspark.session import cut_lineage

TOP = 10
K1 = 8
LENGTH_SHARE = 90
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
SCORES = 1 << 21
# two longs each: a table of at most this many winning classes goes to every task
FEW_CLASSES = 100_000
NO_ID = 2**63 - 1

# ASCII other than digits and letters parts terms; only A-Z are lower-cased
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, some at a time."""
    raw = (text or "").encode().translate(_TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _vectors(shared):
    """Term count and vector (pairs of term number and count, by term number) of every document that has a term."""

    def vectors(batches: Batches) -> Batches:
        vocabulary = shared.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text"):
                n, counts = 0, Counter()
                for some in terms(text.as_py()):
                    n += len(some)
                    counts.update(some)
                sizes.append(n)
                bag = sorted((vocabulary[t], tf) for t, tf in counts.items() if t in vocabulary)
                bags.append(np.array(bag, "<u4").tobytes())
            kept = pa.array(np.flatnonzero(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(kept), pa.array(sizes, pa.int64()).take(kept), pa.array(bags, pa.binary()).take(kept)], ["doc_id", "n", "bag"]
            )

    return vectors


def _frequencies(batches: Batches) -> Batches:
    """Per task: documents that hold each term."""
    df: Counter = Counter()
    for batch in batches:
        held = np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4")[::2]
        numbers, counts = np.unique(held, return_counts=True)
        df.update(dict(zip(numbers.tolist(), counts.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "df"])


def _class_scores(bags: list[bytes], m: np.ndarray, weights: np.ndarray, owners: np.ndarray, first: np.ndarray, items: int) -> np.ndarray:
    """Scores of classes (rows) for items (columns); ``owners[first[t]:first[t + 1]]`` are the items that hold term t."""
    pairs = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
    term, tf = pairs[:, 0], pairs[:, 1]
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + K1 * m[row]))
    share = first[term + 1] - first[term]
    at = np.repeat(first[term] - (np.cumsum(share) - share), share) + np.arange(share.sum())
    cell = np.repeat(row * items, share) + owners[at]
    gain = np.repeat(gain, share)
    # sums in doubles are exact below 2^53: add the halves of the numbers apart
    low = np.bincount(cell, gain & 0xFFFFF, minlength=len(bags) * items).astype(np.int64)
    high = np.bincount(cell, gain >> 20, minlength=len(bags) * items).astype(np.int64)
    return ((high << 20) + low).reshape(len(bags), items)


def _best(item, score, least, order: int) -> np.ndarray:
    """Positions of the ``order`` best entries of each item: high score, then least doc_id."""
    by = np.lexsort((least, -score, item))
    starts = np.r_[0, np.flatnonzero(np.diff(item[by])) + 1] if len(by) else np.zeros(0, np.int64)
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[place < order]


def _winners(shared, top: int):
    """Per task: the best classes of every item."""

    def winners(batches: Batches) -> Batches:
        weights, owners, first, items = shared.value
        none = np.zeros(0, np.int64)
        item = score = least = key = m = none
        step = max(1, SCORES // items)
        for batch in batches:
            bags, own_m = batch.column("bag").to_pylist(), batch.column("m").to_numpy()
            own_key, own_least = batch.column("key").to_numpy(), batch.column("least").to_numpy()
            for at in range(0, len(bags), step):
                some = slice(at, at + step)
                scores = _class_scores(bags[some], own_m[some], weights, owners, first, items)
                floor = np.ones(items, np.int64)
                if len(scores) > top:
                    floor = np.maximum(floor, np.partition(scores, len(scores) - top, axis=0)[len(scores) - top])
                # nothing below the worst of ten held winners can win any more
                full = np.bincount(item, minlength=items) >= top
                worst = np.full(items, 2**63 - 1)
                np.minimum.at(worst, item, score)
                floor = np.where(full, np.maximum(floor, worst), floor)
                row, col = np.nonzero(scores >= floor)
                item, score = np.r_[item, col], np.r_[score, scores[row, col]]
                least, key, m = np.r_[least, own_least[at + row]], np.r_[key, own_key[at + row]], np.r_[m, own_m[at + row]]
                held = _best(item, score, least, top)
                item, score, least, key, m = item[held], score[held], least[held], key[held], m[held]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, score, least, key, m)], ["item", "score", "least", "key", "m"])

    return winners


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items with terms, in blocks of bounded text; read row by row, one block on the driver at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        own = sorted({t for some in terms(row["text"]) for t in some})
        if not own:
            continue
        if block and size + len(row["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], own))
        size += len(row["text"])
    if block:
        yield block


def _rank_block(documents: DataFrame, block: list[tuple], item_type: str, top: int) -> DataFrame:
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    holders = sorted((vocabulary[t], i) for i, (_, own) in enumerate(block) for t in own)
    owners = np.array([i for _, i in holders], np.int64)
    first = np.searchsorted(np.array([t for t, _ in holders]), np.arange(len(vocabulary) + 1))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    read = documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(
        _vectors(spark.sparkContext.broadcast(vocabulary)), f"doc_id {id_type}, n bigint, bag binary"
    )
    read = cut_lineage(read)
    # at most one row for each term of the block comes back
    df = read.select("bag").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    docs, total = read.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df:
        weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {docs}L) DIV {total or 1}L")
    found = read.where("octet_length(bag) > 0").select("doc_id", m.alias("m"), "bag").withColumn("key", F.xxhash64("m", "bag"))
    # the bytes are part of the grouping: equal hashes alone make no class
    classes = found.groupBy("key", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).cast("bigint").alias("least"))
    shared = spark.sparkContext.broadcast((weights, owners, first, len(block)))
    tasks = classes.mapInArrow(_winners(shared, top), "item bigint, score bigint, least bigint, key bigint, m bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    won = cut_lineage(tasks.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place"))
    # members of classes that won a place: the first of each class by doc_id
    wanted = won.select("key", "m").distinct()
    if len(block) * top <= FEW_CLASSES:
        # no shuffle in front of the join: each task sends only its first members of a class
        wanted = F.broadcast(wanted)
    order = Window.partitionBy("key", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = (
        found.join(wanted, ["key", "m"], "left_semi").withColumn("member", F.row_number().over(order)).where(F.col("member") <= top)
        .withColumn("least", F.first(F.coalesce("doc_id", F.lit(NO_ID))).over(order)).select("key", "m", "least", "doc_id", "member")
    )
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "member")
    ranked = (
        won.join(members, ["key", "m", "least"]).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    )
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item bigint, item_id {item_type}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` best rows of ``documents`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (items, "item_id")))
    result = documents.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score bigint")
    for block in _blocks(items, block_bytes):
        result = result.unionByName(_rank_block(documents, block, item_type, top))
    return result
