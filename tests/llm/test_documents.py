"""Operators on documents against brute force, and their defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm import bpe, chunks, cotraining, langid, licenses, pfair, wand
from lexspark.llm.components import connected_components
from lexspark.llm.jaccard import jaccard_components
from lexspark.llm.logbilinear import language_model_scores

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def brute_components(texts, size, num, den):
    sets, parent, where = {}, {i: i for i in texts}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        shared = Counter(j for g in sets[i] for j in where[g])
        for g in sets[i]:
            where[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (2, 50, 100)])
def test_jaccard_components(documents, texts, size, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents, size, num, den).collect()}
    assert got == brute_components(texts, size, num, den)


def test_jaccard_near_copies_of_a_group(spark):
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i % 5):
            w[(i * 7 + k * 31) % 150] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(dict(rows), 3, 90, 100)


def test_jaccard_defined_cases(odd, none):
    rows = jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert by[0][1] == by[1][1] == 0 and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[5][1] == by[6][1] == 5 and by[7] == (1, 7)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_components(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 50), (60, 60), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 0), 50: 40, 41: 40}


def test_token_counts(documents, texts, odd, none):
    tokenizer = Tokenizer.from_file(VOCABULARY)

    def want(t):
        return len(tokenizer.encode(t or "", add_special_tokens=False).ids)

    for r in bpe.token_counts(documents, VOCABULARY).collect():
        assert (r.n_tokens, r.n_bytes) == (want(texts[r.doc_id]), len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 512)
    got = sorted((r.n_bytes, r.n_tokens) for r in bpe.token_counts(odd, VOCABULARY).collect())
    assert got == sorted((len((r.text or "").encode()), want(r.text)) for r in odd.collect())
    assert bpe.token_counts(none, VOCABULARY).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAb eté'sll漢!,12\n\t <|endoftext>"), max_size=60))
def test_token_count_of_any_text(text):
    assert _vocabulary().count(text) == len(_tokenizer().encode(text, add_special_tokens=False).ids)


def _vocabulary(kept=[]):  # noqa: B006
    if not kept:
        with open(VOCABULARY, encoding="utf-8") as f:
            kept.append(bpe.Vocabulary(f.read()))
    return kept[0]


def _tokenizer(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(VOCABULARY))
    return kept[0]


def test_long_piece():
    assert _vocabulary().count("ab" * 20_000) == len(_tokenizer().encode("ab" * 20_000).ids)


def test_edited_fingerprints(documents, texts, odd, none, spark):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in chunks.edited_fingerprints(documents).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        r = got[i]
        own, other, following = chunks.fingerprints([text.encode(), edited, after.encode()])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (chunks.encode(own), chunks.encode(other))
        assert (r.near_edited, r.near_next) == (chunks.containment(own, other), chunks.containment(own, following))
        assert chunks.decode(r.fingerprint) == own
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > 0.5 for r in long) > 0.97 * len(long)
    assert chunks.edited_fingerprints(odd).count() == odd.count()
    assert chunks.edited_fingerprints(none).collect() == []
    one = chunks.edited_fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id bigint, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_chunks_resist_shifts():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = chunks.fingerprints([text, b"inserted at the head " + text])
    assert chunks.containment(a, b) > 0.99 and chunks.containment(a, a) == 1.0


def test_language_ids(documents, odd, none):
    rows = langid.language_ids(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    by = defaultdict(list)
    for r in langid.language_ids(odd).collect():
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (2, 3, 4, 8)) and len(by[1]) == 2
    assert langid.language_ids(none).collect() == []


def test_naive_bayes_equals_brute_force(spark):
    rows = [("en", "the cat and the dog"), ("fr", "le chat et le chien"), ("en", "a dog")]
    langs, log_p, prior = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["en", "fr"] and np.allclose(np.exp(log_p).sum(0), 1, atol=1e-3) and np.allclose(prior, np.log([3 / 5, 2 / 5]))


def test_language_model(documents, texts, odd, none):
    def tokens(t):
        return [*words(t), None]

    def check(rows, texts_of):
        training = [t for i, t in texts_of if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        c = Counter(x for t in training for x in tokens(t))
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for i, t in texts_of)
        assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows)
        assert all(r.train_tokens == n for r in rows)

    rows = language_model_scores(documents).collect()
    check(rows, list(texts.items()))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    check(language_model_scores(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert language_model_scores(none).collect() == []


def test_every_position_is_a_training_target():
    from types import SimpleNamespace

    import pyarrow as pa

    from lexspark.llm.logbilinear import UNITS, Model, Units, _trainer

    noise = np.full(UNITS, 1 / UNITS)
    shared = SimpleNamespace(value=(Units(np.zeros(0, np.uint64), np.zeros(1 << 16, np.int16)), noise, Model.start(noise).flat))
    batch = pa.RecordBatch.from_pydict({"text": ["one two three four five", "six", None]})
    assert [b.column("seen").to_pylist() for b in _trainer(shared, 0)(iter([batch]))] == [[6 + 2 + 1]]


def test_unit_probabilities_add_up():
    from lexspark.llm.logbilinear import CONTEXT, UNITS, Model

    model = Model.start(np.full(UNITS, 1 / UNITS))
    context = np.full((CONTEXT, UNITS), 3)
    assert abs((10 ** model.log10_units(context, np.arange(UNITS))).sum() - 1) < 1e-6


def test_quality(spark, sf, documents, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = cotraining.train(documents, labels)
    rows = cotraining.classify(documents, model).join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    scored = cotraining.classify(odd, model)
    assert scored.count() == odd.count() and scored.columns[-1] == "keep" and scored.where("score IS NULL").count() == 0
    assert cotraining.train(odd, labels.limit(0)) is None
    assert cotraining.classify(odd, None).where("keep").count() == odd.count()
    assert cotraining.classify(none, model).collect() == []


def test_mixing(documents, odd, none):
    rows = pfair.mix(documents.select("doc_id", "source"), block=2).collect()
    assert len(rows) == documents.count()
    source_of = {}
    for r in rows:
        assert source_of.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(source_of) == list(range(len(source_of)))
    weight = {r.source: r.target_weight for r in rows if r.on_target}
    sent, horizon = Counter(), max(r.slot for r in rows if r.on_target)
    for slot in range(horizon + 1):
        sent[source_of[slot][0]] += 1
        assert all(abs(sent[s] - w * (slot + 1)) < 1.01 for s, w in weight.items())
    assert pfair.mix(odd).count() == odd.count() and pfair.mix(odd, {"s0": 1.0}).where("slot IS NULL").count() == 0
    assert pfair.mix(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12))
def test_schedule_deviates_by_less_than_a_block(sizes):
    shares = pfair.quanta(dict(enumerate(map(float, sizes))), 64)
    slots = pfair.schedule(shares, 64)
    assert sorted(x for s in slots.values() for x in s) == list(range(64))
    for k, q in shares.items():
        done = np.cumsum(np.isin(np.arange(64), slots[k]))
        assert np.abs(done - q * np.arange(1, 65) / 64).max() < 1


def test_exact_weights_keep_the_bound_over_many_slots():
    weights = dict.fromkeys(range(20), 1.0) | {"small": 20 / 9_999}
    total = sum(map(Fraction, weights.values()))
    slots, on_target = pfair.timetable({k: 800 if k != "small" else 5 for k in weights}, weights)
    assert on_target > 10_000 and sorted(np.concatenate(list(slots.values())).tolist()) == list(range(20 * 800 + 5))
    for k, w in weights.items():
        share = float(Fraction(w) / total)
        done = np.cumsum(np.isin(np.arange(on_target), slots[k]))
        assert np.abs(done - share * np.arange(1, on_target + 1)).max() < 1


def test_every_source_has_its_own_weight(spark):
    sizes = {f"host{i:04d}": 3 + i % 5 for i in range(700)}
    rows = [(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = pfair.mix(table, block=1).collect()
    whole = sum(n**pfair.FLATTEN for n in sizes.values())
    assert len(got) == len(rows) and sorted(r.slot for r in got) == list(range(len(rows)))
    assert all(abs(r.target_weight - sizes[r.source] ** pfair.FLATTEN / whole) < 1e-12 for r in got)
    for r in got:
        if r.on_target:
            # sent before and after its slot, against what is due
            assert -1 < r.block - r.target_weight * r.slot and r.block - r.target_weight * (r.slot + 1) < 1
    # a weight given for one of the smallest sources counts
    small = min(sizes, key=lambda s: (sizes[s], s))
    got = pfair.mix(table, {small: 1.0}, block=1).where("slot < 3").collect()
    assert {r.source for r in got} == {small} and all(r.target_weight == 1.0 for r in got)


def test_leaks(spark, sf, documents, texts, odd, none):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in wand.leaks(documents, benchmark).collect()}
    assert got == {(i, r.item_id) for i, t in texts.items() for r in benchmark.collect() if r.text in t}
    items = spark.createDataFrame([(1, "Where did the cat sit? It sat on the mat"), (2, None), (None, " "), (3, "mot")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " * 300 + "where DID the cat sit? it sat on the mat" + " y" * 99), (2, "where did the dog sit? on the mat"), (3, "mot"), (3, "mot")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in wand.leaks(docs, items).collect()) == [(1, 1), (3, 3), (3, 3)]
    assert [r.doc_id for r in wand.clean(docs, items).collect()] == [2]
    assert wand.clean(odd, items).count() == odd.count() - 1 and wand.leaks(odd, items.limit(0)).collect() == []
    assert wand.leaks(none, items).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdefgh ", min_size=1, max_size=40), min_size=1, max_size=60), st.text("abcdefgh ", max_size=40), st.sampled_from([0.2, 0.5, 0.9]))
def test_block_max_search_finds_all(items, query, threshold):
    index = wand.Index(list(enumerate(items)))
    terms = set(wand._hashes(query).tolist())
    scores = Counter()
    for t in terms & set(index.postings):
        for i, s in zip(*index.postings[t][:2], strict=True):
            scores[i] += s
    got = dict(index.search(terms, threshold))
    assert set(got) >= {i for i, s in scores.items() if s >= threshold + 1e-9} and set(got) <= {i for i, s in scores.items() if s >= threshold - 1e-9}


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing here"), ("a/b/y.txt", "Text. Licensed under the Apache License, Version 2.0. More text of so many words that the licence is the smaller part."),
        ("c/z.txt", ""), (None, None), ("top.txt", None), ("a/b/x.txt", "nothing here"), ("a/b/c/LICENSE.md", "Licensed under CC BY-NC 4.0."), ("a/b/c/d/e.txt", "a license of no kind"),
    ]
    got = Counter((r.path, r.own_license, r.license, r.from_folder) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == Counter([
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.txt", None, "MIT", "a"), ("a/b/x.txt", None, "MIT", "a"), ("a/b/y.txt", "Apache-2.0", "Apache-2.0", None),
        ("c/z.txt", None, None, None), (None, None, None, None), ("top.txt", None, None, None), ("a/b/c/LICENSE.md", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        ("a/b/c/d/e.txt", None, "CC-BY-NC-4.0", "a/b/c"),
    ])
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_licenses_by_name_expression_and_denial(spark):
    warranty = next(t for n, t in licenses.TEXTS if n == "MIT" and t.startswith("THE SOFTWARE"))
    stated = [
        ("License: BSD-3-Clause", "BSD-3-Clause"), ("License: MIT.", "MIT"), ('"license": "Apache-2.0",', "Apache-2.0"), ("NOT released under the MIT License", None),
        ("This is not licensed under the Apache License, Version 2.0.", None), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"), ("It is distributed under GPLv3", "GPL-3.0"),
        ("Released under MIT.", "MIT"), ("Distributed under the GNU GPL version 3.", "GPL-3.0"), ("Available under the terms of the LGPL 2.1", "LGPL-2.1"),
        ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("License: see the folder", None),
        ("He lives under mitigated rules", None), (warranty, "MIT"), ("a license of no kind", None),
    ]
    rows = [(f"d{i}/x.txt", t, "x") for i, (t, _) in enumerate(stated)]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, license_terms string")).collect()}
    assert [got[f"d{i}/x.txt"] for i in range(len(stated))] == [w for _, w in stated]


def test_license_of_a_very_long_text(spark):
    rows = [("a/LICENSE", "no words of that kind. " * 60000 + "\n\nReleased under the MIT License.\n"), ("a/x", "")]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": "MIT", "a/x": "MIT"}


def test_license_cosine_equals_brute_force(spark):
    units = [t for _, t in licenses.TEMPLATES] + ["Licensed under the Apache License", "the terms of the license, version 3", "Released under the MIT or the ISC License"]
    df = Counter(w for _, t in licenses.TEMPLATES for w in set(re.findall(licenses.TERM.replace("(", "(?:"), t.lower())))

    def vector(text):
        return {w: n * (math.log((1 + len(licenses.TEMPLATES)) / (1 + df[w])) + 1) for w, n in Counter(re.findall(licenses.TERM.replace("(", "(?:"), text.lower())).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    want = sorted(round(max(cosine(vector(u), vector(t)) for _, t in licenses.TEMPLATES), 6) for u in units)
    # a unit that stands in many files counts as often
    got = licenses._best(spark.createDataFrame([(u,) for u in units + units[:3] * 4], "unit string"), licenses.TEMPLATES, 0.0).collect()
    assert sorted(r.cosine for r in got) == pytest.approx(want, abs=2e-6)


def test_license_tags_headers_and_whole_texts(spark):
    gnu = licenses._GNU.format("Affero General", 3).replace("and/or modify ", "and/or modify\n# ")
    rows = [
        ("a/x.py", "# SPDX-License-Identifier: Apache-2.0\nimport x"), ("b/x.py", "// SPDX-License-Identifier: MIT"), ("c/x.py", "# SPDX-License-Identifier: GPL-3.0-or-later"),
        ("d/LICENSE", "Copyright (c) 2020 A. Holder\n\n" + licenses._BSD + licenses._BSD_END), ("e/x.py", f"# Copyright 2020 A\n#\n# {gnu}\n\nimport x\n"),
        ("f/LICENSE", licenses._TEXTS["MPL-2.0"]), ("f/y.py", "print(1)"), ("g/x.py", "# SPDX-License-Identifier: Nobody-1.0"),
    ]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x.py": "Apache-2.0", "b/x.py": "MIT", "c/x.py": "GPL-3.0", "d/LICENSE": "BSD-2-Clause", "e/x.py": "AGPL-3.0", "f/LICENSE": "MPL-2.0", "f/y.py": "MPL-2.0", "g/x.py": None}


def test_license_plan_holds_the_scan_once(spark):
    files = spark.createDataFrame([("a/x.txt", "Released under the MIT License.")], "path string, text string")
    plan = licenses.scan(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.count("regexp_extract_all") == 0


def test_plans_of_a_license_scan_do_not_hold_the_templates_steps(spark):
    units = spark.createDataFrame([("Released under the MIT License.",)], "unit string")
    best = licenses._best(units, licenses.TEMPLATES, licenses.THRESHOLD)
    assert [r.license for r in best.collect()] == ["MIT"]
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
