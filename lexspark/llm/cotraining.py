"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed words and hashed word endings; the metadata view sees source,
language and layout (length, lines, shares of character kinds, repeated words). Both are
logistic regressions, fitted on the driver on a bounded sample: the LABELLED labels and
POOL documents of the least id hashes. Over ROUNDS rounds each view gives its
most confident labels of pool documents to the other. Each view is then calibrated
on labels it did not train on, and the mean of the two calibrated log-odds scores
every document.

Defined cases: a null or empty text has zero features and is scored by the rest; labels
with a null id or quality teach nothing, repeated labels of an id are averaged (a tie
counts as good); without labels of both classes every document is kept with score 1;
repeated rows are scored each; extra columns of the documents are kept by ``classify``
unless they bear the name of a result column, which replaces them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches
from lexspark.llm.words import chunks, split_words, text_buffer

LABELLED, POOL, ROUNDS, EXCHANGED = 4000, 2000, 4, 100
CONFIDENT = 0.95
KEEP_FROM = 0.5
WORD_BUCKETS, END_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 768, 256, 16, 8
RESULT = ["p_text", "p_meta", "score", "keep"]

_KINDS = np.zeros((6, 256), np.float32)
for _row, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (10,), (32, 9, 11, 12, 13), range(128, 256))):
    _KINDS[_row, list(_bytes)] = 1


def _hash_bucket(values: list, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(str(v).encode()) % buckets for v in values], np.int64)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the text view and of the metadata view; needs text, source and lang."""
    rows = batch.num_rows
    data, offsets = text_buffer(batch.column("text"))
    text = np.zeros((rows, WORD_BUCKETS + END_BUCKETS), np.float32)
    layout = np.zeros((rows, 12), np.float32)
    for at, end in chunks(offsets):
        words, n = split_words(data, offsets[at : end + 1]), end - at
        count = np.diff(words.first)
        owner = np.repeat(np.arange(n), count)
        per_row = np.maximum(count, 1)[:, None]
        bucket = ((words.hashes >> np.uint64(32)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        text[at:end, :WORD_BUCKETS] = np.bincount(owner * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, -1) / per_row
        if len(words.ends):
            before = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
            tail = (before * 31 + data[words.ends - 1]) * 2654435761 % 2**32 * END_BUCKETS >> 32
            text[at:end, WORD_BUCKETS:] = np.bincount(owner * END_BUCKETS + tail, minlength=n * END_BUCKETS).reshape(n, -1) / per_row
        b = data[offsets[at] : offsets[end]]
        size = np.diff(offsets[at : end + 1])
        filled = size > 0
        starts = (offsets[at:end] - offsets[at])[filled]
        kinds = np.zeros((n, 6))
        if len(starts):
            for k in range(6):
                kinds[filled, k] = np.add.reduceat(_KINDS[k][b], starts, dtype=np.float64)
        part = layout[at:end]
        bytes_per_row = np.maximum(size, 1)
        part[:, 0], part[:, 1] = np.log1p(size), np.log1p(kinds[:, 3])
        part[:, 2] = np.log1p(size / (kinds[:, 3] + 1))
        part[:, 3:8] = kinds[:, [0, 1, 2, 4, 5]] / bytes_per_row[:, None]
        part[:, 8] = 1 - kinds.sum(1) / bytes_per_row  # symbols
        for column, lag in ((9, 1), (10, 2), (11, 3)):
            same = (words.hashes[lag:] == words.hashes[:-lag]) & (owner[lag:] == owner[:-lag])
            part[:, column] = np.bincount(owner[lag:][same], minlength=n) / per_row[:, 0]
    kinds = np.zeros((rows, SOURCE_BUCKETS + LANG_BUCKETS), np.float32)
    kinds[np.arange(rows), _hash_bucket(batch.column("source").to_pylist(), SOURCE_BUCKETS)] = 1
    kinds[np.arange(rows), SOURCE_BUCKETS + _hash_bucket(batch.column("lang").to_pylist(), LANG_BUCKETS)] = 1
    return np.sqrt(text), np.hstack([layout, kinds])


class View:
    """Logistic regression over standardised features, with a calibration on top."""

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150) -> View:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        z = ((x - self.mean) / self.scale).astype(np.float32)
        w, b = np.zeros(z.shape[1], np.float32), 0.0
        first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            off = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
            g = np.append(z.T @ off / len(y) + 1e-2 * w, off.mean())
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1].astype(np.float32), b - step[-1]
        self.w, self.b, self.slope, self.shift = w, float(b), 1.0, 0.0
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.w + self.b
        return np.clip(self.slope * raw + self.shift, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling with smoothed targets."""
        raw, good = self.logit(x), y.sum()
        goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + c, -30, 30)))
            d, h = p - goal, np.maximum(p * (1 - p), 1e-6)
            g = np.array([(d * raw).sum() + 1e-3 * (a - 1), d.sum() + 1e-3 * c])
            m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
            da, dc = np.linalg.solve(m, g)
            a, c = a - float(np.clip(da, -1, 1)), c - float(np.clip(dc, -1, 1))
        self.slope, self.shift = max(a, 0.0), c


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> tuple[View, View]:
    """Views that taught each other; every fifth label is kept back for calibration."""
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), bool)
    xs, ys = [[x[~back]] for x in labelled], [[y[~back]], [y[~back]]]
    left = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    views = [View(), View()]
    share = y.mean()
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            views[v].fit(np.vstack(xs[v]), np.concatenate(ys[v]))
        if turn == ROUNDS or not len(pool[0]):
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            p = 1 / (1 + np.exp(-views[teacher].logit(pool[teacher])))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                most = max(1, round(EXCHANGED * (share if label else 1 - share)))
                pick = np.flatnonzero((sure >= CONFIDENT) & left[pupil])
                pick = pick[np.argsort(-sure[pick], kind="stable")[:most]]
                left[pupil][pick] = False
                xs[pupil].append(pool[pupil][pick])
                ys[pupil].append(np.full(len(pick), label))
    check = back if back.any() else ~back
    for v in (0, 1):
        views[v].calibrate(labelled[v][check], y[check])
    return views[0], views[1]


def _sample(batches: Batches) -> Batches:
    for batch in batches:
        text, meta = features(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())],
            ["doc_id", "quality", "text_view", "meta_view"])


def train(documents: DataFrame, labels: DataFrame) -> tuple[View, View] | None:
    """The two views, or None if the labels do not show both classes."""
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    judged = judged.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    ids = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    if len(set(ids.values())) < 2:
        return None
    spread = F.xxhash64("doc_id", F.lit(1))
    others = documents.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(spread, "doc_id").limit(POOL + LABELLED).collect()
    for r in [r for r in others if r["doc_id"] not in ids][:POOL]:
        ids[r["doc_id"]] = -1
    wanted = documents.sparkSession.createDataFrame(list(ids.items()), "doc_id bigint, quality int")  # LABELLED + POOL rows at most
    got = (
        documents.select("doc_id", "text", "source", "lang").join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])
        .mapInArrow(_sample, "doc_id bigint, quality int, text_view binary, meta_view binary").collect()
    )
    got = sorted(got, key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    y = np.array([r["quality"] for r in got])
    views = [np.vstack([np.frombuffer(r[name], np.float32) for r in got]) for name in ("text_view", "meta_view")]
    known = y >= 0
    if len(set(y[known])) < 2:
        return None
    return co_train((views[0][known], views[1][known]), y[known].astype(np.float64), (views[0][~known], views[1][~known]))


def _scorer(shared, kept: list[str]):
    def score(batches: Batches) -> Batches:
        views = shared.value
        for batch in batches:
            logits = [v.logit(x) for v, x in zip(views, features(batch), strict=True)]
            p = [1 / (1 + np.exp(-z)) for z in (*logits, (logits[0] + logits[1]) / 2)]
            out = [pa.array(x.astype(np.float64)) for x in p]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out, pa.array(p[2] >= KEEP_FROM)], [*kept, *RESULT])

    return score


def classify(documents: DataFrame, model: tuple[View, View] | None) -> DataFrame:
    """``documents`` with p_text, p_meta, score (calibrated probability of good quality) and keep."""
    documents = documents.drop(*RESULT)
    if model is None:
        return documents.withColumns({**{c: F.lit(1.0) for c in RESULT[:3]}, "keep": F.lit(True)})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(_scorer(shared, documents.columns), f"{fields}, p_text double, p_meta double, score double, keep boolean")
