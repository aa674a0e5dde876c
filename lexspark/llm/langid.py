"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (orders 1 to 3, lower-cased code points) of every
labelled text in a table of languages by buckets; the sums run as one shuffle.
The log-probability matrix has (languages x BUCKETS) entries, a size that does not
depend on the texts; it is broadcast, and every batch of texts is scored with
numpy gathers.

Defined cases: a null text or one without a letter is ``und`` with score 0; if
nothing can be learned from (no rows, no labels), every text is ``und`` with score
0; equal posteriors fall to the first language by name; a null id trains and is
not held out. Repeated rows count as often as they occur. Extra columns are kept
by ``identify`` unless they bear the name of a result column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches, crc_mod

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = 3
PIECE_CHARS = 1 << 18
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _pieces(texts: list[str]):
    """Groups of texts of about PIECE_CHARS code points: first index, buckets (order by order), start of each text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE_CHARS):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        starts = np.zeros(len(group) + 1, np.int64)
        np.cumsum([len(t) + ORDERS for t in group], out=starts[1:])
        codes = np.frombuffer((("\n" * ORDERS).join(group) + "\n" * ORDERS).encode("utf-32-le", "surrogatepass"), np.uint32)
        value, grams = np.zeros(len(codes), np.uint32), []
        for k in range(ORDERS):
            shifted = np.full(len(codes), 10, np.uint32)
            shifted[: len(codes) - k] = codes[k:]
            value = (value ^ (shifted + np.uint32(k + 1))) * _FACTORS[k]
            value ^= value >> np.uint32(15)
            grams.append((value * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS))
        yield at, grams, starts
        at = end


def _count(batches: Batches) -> Batches:
    totals: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
        langs = batch.column("lang").to_pylist()
        for lang in langs:
            documents[lang] = documents.get(lang, 0) + 1
        for at, grams, starts in _pieces(texts):
            names = sorted(set(langs[at : at + len(starts) - 1]))
            code = {x: i for i, x in enumerate(names)}
            owner = np.repeat([code[x] for x in langs[at : at + len(starts) - 1]], np.diff(starts)).astype(np.int64) * BUCKETS
            got = sum(np.bincount(owner + g, minlength=len(names) * BUCKETS) for g in grams).reshape(len(names), BUCKETS)
            for x, i in code.items():
                totals[x] = totals.get(x, 0) + got[i]
    for lang, vector in totals.items():
        used = np.flatnonzero(vector)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * (len(used) + 1)), "bucket": pa.array(np.append(used, -1).astype(np.int32)),
            "n": pa.array(np.append(vector[used], documents[lang]).astype(np.int64)),
        })


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log-probability matrix (buckets x languages) and log priors.

    ``labelled`` has ``text`` and ``lang``; rows without either teach nothing.
    """
    rows = (
        labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
        .mapInArrow(_count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(rows["lang"].unique())
    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    index = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    bucket, n = rows["bucket"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64)
    counts[index[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    docs[index[bucket < 0]] = n[bucket < 0]
    log_p = np.log(counts + 1.0) - np.log(counts.sum(1, keepdims=True) + BUCKETS)
    return langs, np.ascontiguousarray(log_p.T, np.float32), np.log((docs + 1) / (docs.sum() + len(langs)))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _scorer(shared, langs: list[str]):
    def score(batches: Batches) -> Batches:
        matrix, prior = shared.value
        columns = np.ascontiguousarray(matrix.T)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            total = np.tile(prior, (len(raw), 1))
            for at, grams, starts in _pieces([(t or "").lower() for t in raw]):
                for j in range(len(langs)):
                    logs = sum(columns[j][g] for g in grams)
                    total[at : at + len(starts) - 1, j] += np.add.reduceat(logs, starts[:-1], dtype=np.float64)
            best = total.argmax(1)
            with np.errstate(under="ignore"):
                post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            known = [_has_letter(t) for t in raw]
            lang = pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string())
            value = pa.array([float(p) if k else 0.0 for p, k in zip(post, known, strict=True)], pa.float64())
            kept = [c for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lang, value], [*kept, "lang_pred", "score"])

    return score


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    langs, matrix, prior = model
    documents = documents.drop("lang_pred", "score")
    if not langs:
        return documents.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast((matrix, prior))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(_scorer(shared, langs), f"{fields}, lang_pred string, score double")


def language_ids(documents: DataFrame) -> DataFrame:
    """Language of every document, learned from the rows whose crc32(doc_id) modulo 5 is not 0."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = train(documents.where(~held).select("text", "lang"))
    return identify(documents.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
