"""Document fingerprints: content-defined chunks cut by a normalised gear hash.

A gear hash (32-byte window, computed for all positions of a batch by doubling)
proposes boundaries: before the normal size a hard mask, beyond it an easy one, so
that chunk sizes gather round the normal size (normalised chunking). An insertion
moves only the boundaries near it. The fingerprint lists the distinct digests of a
text's chunks, each with the bytes that it covers there; containment of one text in
another is the share of its bytes whose digests the other has too.

``edited_fingerprints`` lets every text meet its successor by descending id. Rows are
dealt out by id ranges in one shuffle; each range also gets the first row of the range
after it, so no window runs over all rows.

Defined cases: a null text is an empty one; an empty text has the fingerprint ``''``,
likeness 1 to another empty text and 0 to any other; a single row is its own
successor; rows with equal ids follow each other by text; null ids come last;
repeated rows give one result row each; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches, partitions
from lexspark.llm.words import CHUNK_BYTES, mix

SMALLEST, NORMAL, LARGEST = 10, 32, 128
HARD_BITS, EASY_BITS = 6, 3
DIGEST_HEX, BYTES_HEX = 12, 6
WINDOW = 32

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def _boundaries(data: bytes, cuts: list[int]) -> list[int]:
    """Chunk ends of the texts that ``cuts`` delimit in ``data``; every cut is an end."""
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    span = 1
    while span < WINDOW:
        moved = np.zeros_like(h)
        moved[span:] = h[:-span] << np.uint32(span)
        h = h + moved
        span *= 2
    top = h >> np.uint32(32 - HARD_BITS)
    easy = np.flatnonzero((top & np.uint32((1 << EASY_BITS) - 1)) == 0)
    hard = top[easy] == 0
    places, is_hard = (easy + 1).tolist(), hard.tolist()
    places.append(1 << 62)
    is_hard.append(True)
    ends, k, at = [], 0, cuts[0]
    for stop in cuts[1:]:
        while at < stop:
            least, middle, most = at + SMALLEST, at + NORMAL, min(at + LARGEST, stop)
            while places[k] < least:
                k += 1
            j = k
            while places[j] < middle and not is_hard[j]:
                j += 1
            at = min(places[j], most)
            ends.append(at)
            k = j if places[j] > at else j + 1
        while places[k] <= stop:
            k += 1
    return ends


def chunk_lists(pieces: list[tuple[bytes, bytes]]) -> Iterator[list[tuple[int, int]]]:
    """Digest and length of the chunks of each piece; a piece comes with the WINDOW bytes before it."""
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= CHUNK_BYTES):
            size += len(pieces[end][1])
            end += 1
        # the gear window of a piece never reaches into its neighbour
        data = b"".join([x for piece in pieces[at:end] for x in piece])
        cuts, start = [], 0
        for _, piece in pieces[at:end]:
            start += WINDOW
            cuts += [start, start + len(piece)]
            start += len(piece)
        # what lies before a piece is cut like a piece and left out
        ends = _boundaries(data, cuts)
        k = 0
        for first, last in zip(cuts[::2], cuts[1::2], strict=True):
            found = []
            while k < len(ends) and ends[k] <= first:
                k += 1
            while first < last:
                stop = ends[k]
                found.append((_digest(data[first:stop]) >> 16, stop - first))
                first, k = stop, k + 1
            yield found
        at = end


_digest = xxhash.xxh3_64_intdigest
BEFORE = bytes(WINDOW)


def weigh(found: list[tuple[int, int]]) -> dict[int, int]:
    """Distinct digests, with the bytes that each covers."""
    weights: dict[int, int] = {}
    for digest, n in found:
        weights[digest] = weights.get(digest, 0) + n
    return weights


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunk digests, with the bytes that each covers in it."""
    return [weigh(x) for x in chunk_lists([(BEFORE, t) for t in texts])]


def encode(found: dict[int, int]) -> str:
    """A fingerprint as text: fields of fixed width, by digest."""
    return "".join(["%018x" % (d << 24 | min(n, 0xFFFFFF)) for d, n in sorted(found.items())])


def decode(fingerprint: str) -> dict[int, int]:
    width = DIGEST_HEX + BYTES_HEX
    return {int(fingerprint[i : i + DIGEST_HEX], 16): int(fingerprint[i + DIGEST_HEX : i + width], 16) for i in range(0, len(fingerprint), width)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes of ``a`` whose chunks ``b`` has too."""
    if not a:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


def _edit(batches: Batches) -> Batches:
    """Rows of one range, by descending id; the row that follows the last one comes as a guest."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True)

    def emit(group, following):
        texts = [t.encode() for _, t, _ in group] + [following.encode()]
        lists = list(chunk_lists([(BEFORE, t) for t in texts]))
        own = [weigh(x) for x in lists]
        heads, rests, hashes = [], [], []
        for i, (_, text, _) in enumerate(group):
            cut = len(text) // 3
            kept = text[: len(text) - cut].encode()
            edited = kept + (group[i + 1][1] if i + 1 < len(group) else following)[:cut].encode()
            hashes.append(hashlib.sha256(edited).hexdigest())
            # chunks that end before the edit are the same; cutting goes on from there
            at = k = 0
            while k < len(lists[i]) and at + lists[i][k][1] <= len(kept) - LARGEST:
                at += lists[i][k][1]
                k += 1
            heads.append(lists[i][:k])
            rests.append(((BEFORE + edited[max(0, at - WINDOW) : at])[-WINDOW:], edited[at:]))
        others = [weigh(head + rest) for head, rest in zip(heads, chunk_lists(rests), strict=True)]
        out = [
            (doc_id, len(text), hashes[i], encode(own[i]), encode(others[i]), containment(own[i], others[i]), containment(own[i], own[i + 1]))
            for i, (doc_id, text, _) in enumerate(group)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    group, size = [], 0
    for row in rows():
        if group and (row[2] or size > CHUNK_BYTES // 2):
            yield emit(group, row[1])
            group, size = [], 0
        if row[2]:
            return
        group.append(row)
        size += len(row[1])


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the last third
    (floor(n/3) code points) gives way to the head of the next text by descending id.
    """
    spark = documents.sparkSession
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    parts = max(2, partitions(spark))
    edges = ids.where("doc_id IS NOT NULL").select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    # range 0 holds the largest ids; null ids share the last range
    place = F.lit(len(edges))
    if edges:
        place = F.coalesce(F.lit(len(edges)) - F.size(F.filter(F.lit(edges), lambda e: F.col("doc_id") >= e)), F.lit(len(edges)))
    heads = [(r[0], r[1]) for r in ids.groupBy(place.alias("part")).agg(F.max("doc_id")).orderBy("part").collect()]
    known = [p for p, _ in heads]
    # the head of each range is also a guest, as the last row, of the range before it (the first one's of the last)
    known = [p for p, _ in heads]
    host = {top: known[i - 1] for i, (_, top) in enumerate(heads)}
    guest_of = F.when(F.col("doc_id").isNull(), F.lit(host.get(None)).cast("int"))
    tops = [x for t, p in host.items() if t is not None for x in (F.lit(t).cast("bigint"), F.lit(p))]
    if tops:
        guest_of = guest_of.otherwise(F.create_map(*tops)[F.col("doc_id")])
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = base.select("doc_id", "text", F.explode(F.array_compact(F.array(
        F.struct(place.alias("part"), F.lit(False).alias("guest")),
        F.when(guest_of.isNotNull(), F.struct(guest_of.alias("part"), F.lit(True).alias("guest"))),
    ))).alias("to")).select("to.part", "doc_id", "text", "to.guest")
    dealt = both.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )
    return dealt.mapInArrow(
        _edit,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
