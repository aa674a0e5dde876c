import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm.packing import Encoder, best_fit, exact_patterns, fit_counts, pack, plan
from lexspark.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected_pieces(library, documents, capacity):
    out = []
    for doc_id, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return sorted(out, key=str)


def check(rows, library, documents, capacity):
    """Pieces as cut by hand, sequences gapless and within capacity; returns the number of sequences."""
    assert sorted((tuple(r[c] for c in COLUMNS[:5]) for r in rows), key=str) == expected_pieces(library, documents, capacity)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_packs_every_piece_near_the_bound(spark, sf, library):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_pattern_packing"](spark, sf)
    assert got.columns == COLUMNS
    rows = got.collect()
    bound = -(-sum(r["length"] for r in rows) // 2048)
    assert check(rows, library, documents, 2048) <= bound + 1


def test_odd_rows_small_capacity_and_empty_table(spark, odd, none, library):
    documents = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for capacity in (2048, 16):
        check(pack(odd.repartition(5), FILE, capacity).collect(), library, documents, capacity)
    assert pack(none, FILE).count() == 0 and pack(none, FILE).columns == COLUMNS


def test_copies_over_many_tasks(spark, library):
    documents = [(i % 3, "the same words again and again") for i in range(300)] + [(i, "w " * i) for i in range(100)]
    df = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(13)
    check(pack(df, FILE, 64).collect(), library, documents, 64)


def test_encoder_equals_the_library(library):
    content = open(FILE, encoding="utf-8").read()
    encoder = Encoder(content)
    assert encoder.fast is not None
    texts = ["", "a" * 5000, "x" + " " * 300_000, " " * 300_000, "it's <|endoftext|>y<|endoftext|> 'LL\t\n　漢字 é\x00\x85 \xa0a 12,5", "<|endoftext"]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    # merges out of the order of their ids are left to the library
    import json

    file = json.loads(content)
    file["model"]["merges"][300:302] = file["model"]["merges"][301:299:-1]
    assert Encoder(json.dumps(file)).fast is None


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_uses_every_piece_once(counts):
    histogram = np.zeros(41, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    for patterns in (plan(histogram, 40), best_fit(histogram, 40)):
        used = Counter()
        for lengths, n in patterns:
            assert sum(lengths) <= 40 and n > 0
            for a in lengths:
                used[a] += n
        assert used == Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_best_fit_on_counts_equals_one_by_one(lengths):
    spaces = []
    for a in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= a]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= a
        else:
            spaces.append(30 - a)
    got = best_fit(np.bincount(lengths, minlength=31), 30)
    assert sorted(30 - sum(own) for own, n in got for _ in range(n)) == sorted(spaces)


def test_patterns_and_fit():
    rows = exact_patterns(np.arange(1, 12), 12)
    want = {(a, 12 - a, 0) for a in range(1, 7)} | {(a, b, 12 - a - b) for a in range(1, 5) for b in range(a, 12) if b <= 12 - a - b}
    assert {tuple(r) for r in rows.tolist()} == want and len(rows) == len(want)
    # a histogram that patterns meet exactly is met; one that they cannot meet has the least weighted squares
    draw = np.random.default_rng(0)
    histogram = np.bincount(rows.ravel(), np.repeat(draw.integers(0, 50, len(rows)), 3), minlength=12)
    histogram[0] = 0
    x = fit_counts(rows, histogram, 5000)
    used = np.bincount(rows.ravel(), np.repeat(x, 3), minlength=12)
    assert (x >= 0).all() and np.abs(used[1:] - histogram[1:]).max() < 0.5
    single = fit_counts(np.array([[5, 7, 0]]), np.array([0, 0, 0, 0, 0, 10, 0, 30, 0, 0, 0, 0]), 500)
    assert single[0] == pytest.approx((5 * 10 + 7 * 30) / 12)


def test_fitted_patterns_beat_best_fit():
    draw = np.random.default_rng(0)
    histogram = np.bincount(np.clip(draw.normal(700, 150, 20_000), 1, 2047).astype(int), minlength=2049)
    assert sum(n for _, n in plan(histogram, 2048)) < sum(n for _, n in best_fit(histogram, 2048))
