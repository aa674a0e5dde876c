import math
import re
from collections import Counter

import pytest

from lexspark.llm.lexical import ranked_search, terms
from lexspark.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id bigint, text string, rank string"


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(documents, items, top=10):
    """(item number, rank, doc_id, score) straight from the formula."""
    bags = [(i, Counter(w)) for i, t in documents if (w := words(t))]
    total, df = sum(sum(b.values()) for _, b in bags), Counter()
    for _, b in bags:
        df.update(b.keys())
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * len(bags)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(words(text)) if t in bag
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def ranked(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", ["", "a", "Ab-c_d é9 漢字,漢\x7fZ", "ÀÉ İx", "x" * 3_000_000 + " y", "the cat " * 300_000])
def test_terms_equal_the_pattern(text):
    assert [t.decode() for some in terms(text) for t in some] == words(text)


def test_query_equals_brute_force(spark, sf):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ranked(QUERIES["op12_bag_ranking"](spark, sf)) == brute(documents, items)


def test_equal_bags_ties_and_blocks(spark):
    # one class of fifteen members, the same words in another order, and equal scores across classes
    documents = [(i, "red fox jumps") for i in range(40, 25, -1)] + [(i, "jumps red FOX") for i in range(10, 13)]
    documents += [(i, "fox green") for i in range(5)] + [(i, "fox blue") for i in range(5, 9)] + [(90, "none of these"), (91, "..."), (92, None)]
    items = [(1, "Fox!"), (2, "red jumps"), (3, "green blue fox"), (3, "green blue fox"), (4, None), (5, "?"), (6, "unseen"), (None, "blue")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id bigint, text string, item_id string, score int").repartition(7)
    i = spark.createDataFrame([(k, t, "r") for k, t in items], ITEMS)
    want = brute(documents, items)
    assert ranked(ranked_search(d, i)) == want
    # a block of its own for nearly every item
    assert ranked(ranked_search(d, i, block_bytes=8)) == want


def test_odd_rows(spark, odd):
    items = [(1, "the cat and the dog"), (2, "漢字 naïve endoftext"), (3, "w1x1 w2x2 tail"), (4, "chat")]
    documents = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert ranked(ranked_search(odd, spark.createDataFrame([(k, t, "r") for k, t in items], ITEMS))) == brute(documents, items)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "cat", "r")], ITEMS)
    assert ranked_search(none, items).count() == 0
    assert ranked_search(odd, items.limit(0)).count() == 0
