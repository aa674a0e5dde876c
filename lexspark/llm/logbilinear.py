"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are the lower-cased words of a text and one end. Their counts over all training
rows are one shuffle. The model predicts a token's unit from the units of the CONTEXT
tokens before it: the OWN most frequent tokens are units of their own, the others share
units by their first two bytes; within a shared unit a token has its add-one relative
frequency, with one place kept for tokens that training never saw. Token
probabilities so add up to one, and their sizes depend on fixed parameters only.

Training is numpy gradient descent with noise samples (unit frequencies), run on every
partition over its own rows (each pass visits every position of all of them);
after a pass the parameters are averaged, weighted by tokens. Scoring multiplies a batch
of context vectors with all unit vectors and normalises. Counts of the frequent tokens
(at most HEAD) are broadcast; the other tokens of a text meet their counts in a join.

Defined cases: a null text is empty and has one token, its end; without training rows
both scores of every text are 0; a null id trains and is not held out; repeated rows are
counted and scored each; extra columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches, crc_mod
from lexspark.llm.words import chunks, split_words, text_buffer
from lexspark.session import cut_lineage

OWN, CODES, SPREAD = 48, 64, 16
UNITS = OWN + CODES + SPREAD
WIDTH, CONTEXT = 16, 5
HEAD = 1 << 17
NOISE, BATCH, PASSES, RATE = 32, 512, 1, 0.15
BUFFER = 1 << 22
END = np.uint64(0x5851F42D4C957F2D)
PIECE = 1 << 14

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _tokens(batch: pa.RecordBatch):
    """First row, token hashes, codes of their first two bytes and the start of each row's tokens, for groups of rows."""
    data, offsets = text_buffer(batch.column("text"))
    for at, end in chunks(offsets):
        words = split_words(data, offsets[at : end + 1])
        rows = end - at
        starts = words.first + np.arange(rows + 1)
        hashes, codes = np.full(starts[-1], END), np.zeros(starts[-1], np.int64)
        place = np.ones(starts[-1], bool)
        place[starts[1:] - 1] = False
        hashes[place] = words.hashes
        if len(words.hashes):
            second = np.where(words.ends - words.starts > 1, _LOWER[data[np.minimum(words.starts + 1, len(data) - 1)]], 0)
            codes[place] = _LOWER[data[words.starts]] * 256 + second
        yield at, hashes, codes, starts


def _count(batches: Batches) -> Batches:
    def emit(hashes, codes):
        value, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        code = np.concatenate(codes)[first]
        for a in range(0, len(value), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(value[a:b].astype(np.int64)), pa.array(code[a:b].astype(np.int32)), pa.array(n[a:b])], ["token", "code", "n"])

    hashes, codes, size = [], [], 0
    for batch in batches:
        for _, h, c, _ in _tokens(batch):
            hashes.append(h)
            codes.append(c.astype(np.int32))
            size += len(h)
        if size > BUFFER:
            yield from emit(hashes, codes)
            hashes, codes, size = [], [], 0
    if size:
        yield from emit(hashes, codes)


class Units:
    """Which unit a token has, and how frequent units are in training."""

    def __init__(self, own: np.ndarray, class_of_code: np.ndarray):
        order = np.argsort(own)
        self.own, self.unit_of_own, self.class_of_code = own[order], order.astype(np.int16), class_of_code

    def of(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        unit = self.class_of_code[codes]
        if len(self.own):
            i = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            hit = self.own[i] == hashes
            unit = np.where(hit, self.unit_of_own[i], unit)
        return unit.astype(np.int64)


def _contexts(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Units of the CONTEXT tokens before each token; UNITS where a text has none."""
    place = np.arange(len(units)) - np.repeat(starts[:-1], np.diff(starts))
    out = np.full((CONTEXT, len(units)), UNITS, np.int64)
    for i in range(CONTEXT):
        out[i, i + 1 :] = np.where(place[i + 1 :] > i, units[: max(0, len(units) - i - 1)], UNITS)
    return out


_WIDE = np.arange(WIDTH)


def _sums_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the ``rows`` that share an index below ``n``."""
    cells = (index[:, None] * WIDTH + _WIDE).ravel()
    return np.bincount(cells, rows.ravel(), minlength=n * WIDTH).reshape(n, WIDTH)


class Model:
    """Context vectors, position weights, unit vectors and biases, kept in one flat array."""

    SHAPES = ((UNITS + 1, WIDTH), (CONTEXT, WIDTH), (UNITS, WIDTH), (UNITS,))

    def __init__(self, flat: np.ndarray):
        self.parts, at = [], 0
        self.flat = flat
        for shape in self.SHAPES:
            n = math.prod(shape)
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, noise: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        model = cls(rng.normal(0, 0.1, sum(math.prod(s) for s in cls.SHAPES)).astype(np.float32))
        model.parts[1][:] = 1.0 / CONTEXT + model.parts[1] * 0.1
        model.parts[3][:] = np.log(noise)
        return model

    def _predicted(self, context: np.ndarray) -> np.ndarray:
        """Sum of the context's vectors, each weighted by its place."""
        vectors, weights = self.parts[:2]
        tables = weights[:, None, :] * vectors[None]
        predicted = tables[0][context[0]]
        for i in range(1, CONTEXT):
            predicted += tables[i][context[i]]
        return predicted

    def step(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, p_noise: np.ndarray, squares: list[np.ndarray]) -> None:
        """One noise-contrastive gradient step (Adagrad)."""
        vectors, weights, outputs, bias = self.parts
        predicted = self._predicted(context)
        shift = np.log(len(noise) * p_noise)
        right = (predicted * outputs[target]).sum(1) + (bias - shift)[target]
        against = outputs[noise]
        wrong = predicted @ against.T + (bias - shift)[noise]
        d_right, d_wrong = 1 / (1 + np.exp(right)), -1 / (1 + np.exp(-wrong))
        d_hat = d_right[:, None] * outputs[target] + d_wrong @ against
        # gradients are sums by unit: of the target, of the noise, and of each place of the context
        g_out = _sums_by(target, d_right[:, None] * predicted, UNITS)
        g_bias = np.bincount(target, d_right, minlength=UNITS)
        np.add.at(g_out, noise, d_wrong.T @ predicted)
        np.add.at(g_bias, noise, d_wrong.sum(0))
        places = np.arange(CONTEXT)[:, None] * (UNITS + 1) + context
        by_place = _sums_by(places.ravel(), np.broadcast_to(d_hat, (CONTEXT, *d_hat.shape)).reshape(-1, WIDTH), CONTEXT * (UNITS + 1))
        by_place = by_place.reshape(CONTEXT, UNITS + 1, WIDTH)
        g_vec = (by_place * weights[:, None]).sum(0)
        g_weight = (by_place * vectors).sum(1)
        for part, g, sq in zip(self.parts, (g_vec, g_weight, g_out, g_bias), squares, strict=True):
            g = (g / len(target)).astype(np.float32)
            sq += g * g
            part += RATE * g / np.sqrt(sq + 1e-8)

    def log10_units(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each target unit."""
        _, _, outputs, bias = self.parts
        out = np.empty(len(target))
        for a in range(0, len(target), PIECE):
            c, t = context[:, a : a + PIECE], target[a : a + PIECE]
            predicted = self._predicted(c)
            scores = predicted @ outputs.T
            scores += bias
            chosen = scores[np.arange(len(t)), t]
            np.clip(scores, -80, 80, out=scores)
            np.exp(scores, out=scores)
            out[a : a + PIECE] = (np.clip(chosen, -80, 80) - np.log(scores.sum(1, dtype=np.float64))) / math.log(10)
        return out


def _trainer(shared, turn: int):
    def fit(batches: Batches) -> Batches:
        units, p_noise, flat = shared.value
        model, seen = Model(flat.copy()), 0
        squares = [np.zeros_like(p) for p in model.parts]
        rng = np.random.default_rng(turn)
        for batch in batches:
            for _, hashes, codes, starts in _tokens(batch):
                target = units.of(hashes, codes)
                context = _contexts(target, starts)
                take = rng.permutation(len(target))
                for a in range(0, len(take), BATCH):
                    pick = take[a : a + BATCH]
                    model.step(context[:, pick], target[pick], rng.choice(UNITS, NOISE, p=p_noise), p_noise, squares)
                    seen += len(pick)
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.flat.astype(np.float64)], pa.list_(pa.float64()))], ["seen", "parameters"])

    return fit


def _scorer(shared):
    def score(batches: Batches) -> Batches:
        units, flat, head, head_counts, unit_total = shared.value
        model = Model(flat) if flat is not None else None
        log_counts, log_total = np.log10(head_counts + 1.0), np.log10(unit_total)
        for batch in batches:
            for at, hashes, codes, starts in _tokens(batch):
                rows = len(starts) - 1
                i = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
                common = head[i] == hashes if len(head) else np.zeros(len(hashes), bool)
                logs = np.where(common, log_counts[i], 0.0) if len(head) else np.zeros(len(hashes))
                if model:
                    target = units.of(hashes, codes)
                    value = model.log10_units(_contexts(target, starts), target)
                    value += np.where(target >= OWN, logs - log_total[target], 0.0)
                else:
                    value = np.zeros(len(hashes))
                rare = ~common
                owner = np.repeat(np.arange(rows), np.diff(starts))[rare]
                found = hashes[rare]
                order = np.lexsort((found, owner))
                owner, found = owner[order], found[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(found)))
                cuts = pa.array(np.searchsorted(owner[first], np.arange(rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(at, rows), batch.column("doc_id").slice(at, rows), batch.column("held_out").slice(at, rows),
                    pa.array(np.diff(starts)), pa.array(np.add.reduceat(common.astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(logs, starts[:-1])), pa.array(np.add.reduceat(value, starts[:-1])),
                    pa.ListArray.from_arrays(cuts, pa.array(found[first].astype(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                ], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "value", "rare", "times"])

    return score


def language_model_scores(documents: DataFrame) -> DataFrame:
    """Unigram baseline and log-bilinear score of every text.

    Learns from the rows whose crc32(doc_id) modulo 7 is not 2.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    texts = documents.where(~held).select("text")
    counts = cut_lineage(
        texts.mapInArrow(_count, "token bigint, code int, n bigint").groupBy("token").agg(F.sum("n").alias("n"), F.min("code").alias("code")))
    by_code = counts.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # 65,536 rows at most
    total, distinct = sum(r["n"] for r in by_code), sum(r["v"] for r in by_code)
    # frequent tokens: as many whole steps of frequency as fit in HEAD
    step = F.floor(F.log2("n") * 32)
    least, taken = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True):
        if taken + r["v"] > HEAD:
            break
        least, taken = r["step"], taken + r["v"]
    frequent = F.lit(False) if least is None else step >= least
    head = sorted((np.uint64(r["token"] % 2**64), r["n"], r["code"]) for r in counts.where(frequent).collect())
    hashes, head_counts = np.array([h for h, _, _ in head], np.uint64), np.array([n for _, n, _ in head], np.float64)

    own = sorted(head, key=lambda x: (-x[1], x[0]))[:OWN]
    rest = {r["code"]: [r["n"], r["v"]] for r in by_code}
    for _, n, code in own:
        rest[code][0] -= n
        rest[code][1] -= 1
    named = sorted(rest, key=lambda c: (-rest[c][0], c))[:CODES]
    class_of_code = (OWN + CODES + np.arange(1 << 16) * 40503 % (1 << 16) % SPREAD).astype(np.int16)
    class_of_code[named] = OWN + np.arange(len(named))
    unit_count, unit_total = np.zeros(UNITS), np.ones(UNITS)
    for i, (_, n, _) in enumerate(own):
        unit_count[i] = n
    for code, (n, v) in rest.items():
        unit_count[class_of_code[code]] += n
        unit_total[class_of_code[code]] += n + v
    units = Units(np.array([h for h, _, _ in own], np.uint64), class_of_code)

    flat = None
    if total:
        p_noise = (unit_count + 1) / (unit_count + 1).sum()
        flat = Model.start(p_noise).flat
        for turn in range(PASSES):
            shared = sc.broadcast((units, p_noise, flat))
            rows = texts.mapInArrow(_trainer(shared, turn), "seen bigint, parameters array<double>").where("seen > 0")
            means = (
                rows.select("seen", F.posexplode("parameters").alias("i", "p")).groupBy("i")
                .agg((F.sum(F.col("p") * F.col("seen")) / F.sum("seen")).alias("p")).collect()
            )  # as many rows as the model has parameters
            flat = flat.copy()
            for r in means:
                flat[r["i"]] = r["p"]

    shared = sc.broadcast((units, flat, hashes, head_counts, unit_total))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    scored = cut_lineage(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text").mapInArrow(
        _scorer(shared), f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, logs double, value double, rare array<bigint>, times array<bigint>"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), "t.times")
    rare_logs = (
        rare.join(counts.where(~frequent).select("token", "n"), "token")
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    )
    constant = math.log10(total + distinct + 1)
    # a rare token is never a unit of its own, so its count enters both scores
    found = scored.drop("rare", "times").join(rare_logs, "row", "left").na.fill(0, ["rare_logs", "rare_known"])
    base = F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(constant)
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (F.col("value") + F.col("rare_logs") if flat is not None else base).alias("score"),
    )
