"""Centroid clustering whose nearest-centroid search runs on Walsh-Hadamard coefficients.

Vectors and centroids are integers. Both are transformed exactly (additions only), which
keeps squared distances up to the factor of the vector's size. A search adds up squared
coefficient differences from coarse to fine (few sign changes first): the sum over the
coefficients seen so far can only grow, so a centroid whose sum already exceeds a full
distance found for this vector is strictly farther and leaves. Those that stay get all
coefficients, so distances are exact and ties fall to the smaller number.

A round is one pass over the vectors: every task sends the count, the component sums and
the distance sum of each centroid, which Spark adds up; the driver holds only centroids.

Defined cases: vectors of another size, or with a null or non-finite component, are left
out, as are null vectors; with fewer vectors than centroids every vector starts one; a
null id gets a cluster but never starts a centroid (without any id the result is empty); repeated rows count as often as they
occur, equal ids start centroids in the order of their components; an empty table gives
an empty result; extra columns are ignored. A scaled component is held to +-(2^27 - 1),
beyond which no long holds a squared distance; sums of distances stop at the largest long.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches

SIZE = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
START = "2:"
LARGEST = 2**27 - 1
# below this, squared coefficient differences of SIZE components fit in 63 bits
WIDE = 2**24
LEVELS = (2, 4, 8, 16, 32, 64)


def _sign_changes(size: int) -> np.ndarray:
    """Order of the transform's rows by their number of sign changes."""
    rows = transform(np.eye(size, dtype=np.int64))
    return np.argsort((np.diff(np.sign(rows), axis=0) != 0).sum(0), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, in natural order; the row size is a power of two."""
    n, size = x.shape
    width = 1
    while width < size:
        pairs = x.reshape(n, size // (2 * width), 2, width)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        width *= 2
    return x


ORDER = _sign_changes(SIZE)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of every row, and how many differences were squared."""
    n, size = vectors.shape
    kind = np.int64 if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < WIDE else object
    t = transform(vectors.astype(kind))[:, ORDER]
    c = transform(centroids.astype(kind))[:, ORDER]
    first = LEVELS[0]
    seen = ((t[:, None, :first] - c[None, :, :first]) ** 2).sum(2)
    # a full distance of each row: no centroid beyond it can be the nearest
    guess = seen.argmin(1)
    limit = ((t - c[guess]) ** 2).sum(1)
    row, col = np.nonzero(seen <= limit[:, None])
    total = seen[row, col]
    work = n * len(c) * first + n * size
    for done, upto in zip(LEVELS, LEVELS[1:], strict=False):
        total = total + ((t[row, done:upto] - c[col, done:upto]) ** 2).sum(1)
        work += len(row) * (upto - done)
        stay = total <= limit[row]
        row, col, total = row[stay], col[stay], total[stay]
    # rows come in order, the numbers of a row too; every row keeps its guess at least
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, starts) if n else total
    hit = np.flatnonzero(total == least[row])
    best = col[hit[np.searchsorted(row[hit], np.arange(n))]]
    return best, (least // size).astype(np.int64), work


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold SIZE finite components, and their scaled integers."""
    lists = column.cast(pa.list_(pa.float64()))
    right = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == SIZE)
    flat = lists.take(pa.array(right)).flatten()
    missing = np.asarray(flat.is_null()).reshape(-1, SIZE)
    values = np.asarray(flat.fill_null(0.0)).reshape(-1, SIZE)
    fine = ~missing.any(1) & np.isfinite(values).all(1)
    scaled = np.clip(np.floor(SCALE * values[fine]), -LARGEST, LARGEST)
    return right[fine], scaled.astype(np.int64)


def _sums(centroids: np.ndarray):
    """Per task: count, distance sum and component sums of every centroid that is some vector's nearest."""

    def sums(batches: Batches) -> Batches:
        k = len(centroids)
        counts, parts, far = np.zeros(k, np.int64), np.zeros((k, SIZE), np.int64), [0] * k
        for batch in batches:
            _, vectors = whole_vectors(batch.column("embedding"))
            best, distance, _ = nearest(vectors, centroids)
            order = np.argsort(best, kind="stable")
            used, starts = np.unique(best[order], return_index=True)
            if len(used):
                parts[used] += np.add.reduceat(vectors[order], starts, axis=0)
                counts += np.bincount(best, minlength=k)
                for j, d in zip(used, np.split(distance[order], starts[1:]), strict=True):
                    far[j] += sum(d.tolist())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array([Decimal(far[j]) for j in used], pa.decimal128(38, 0)),
             *[pa.array(parts[used, i]) for i in range(SIZE)]],
            ["cluster", "n", "inertia", *[f"s{i}" for i in range(SIZE)]],
        )

    return sums


def _round(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple]:
    """Count, distance sum and component sums by centroid: at most one row for each centroid reaches the driver."""
    fields = ["n bigint", "inertia decimal(38,0)", *[f"s{i} bigint" for i in range(SIZE)]]
    tasks = vectors.mapInArrow(_sums(centroids), "cluster int, " + ", ".join(fields))
    rows = tasks.groupBy("cluster").agg(*[F.sum(f.split()[0]).alias(f.split()[0]) for f in fields]).collect()
    return {r["cluster"]: (r["n"], int(r["inertia"]), [r[f"s{i}"] for i in range(SIZE)]) for r in rows}


def _start(embeddings: DataFrame, centroids: int) -> np.ndarray:
    """The kept vectors of the smallest id hashes."""
    whole = F.expr(f"size(embedding) = {SIZE} AND forall(embedding, x -> coalesce(abs(x) < CAST('Infinity' AS DOUBLE), false))")
    first = (
        embeddings.where(whole & F.col("vec_id").isNotNull())
        .select(F.sha2(F.concat(F.lit(START), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
        .orderBy("hash", "embedding").limit(centroids).collect()
    )
    return whole_vectors(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())))[1]


def _assign(centroids: np.ndarray, inertia: list[int], digests: list[str]):
    largest = 2**63 - 1

    def assign(batches: Batches) -> Batches:
        own = np.array([min(x, largest) for x in inertia], np.int64)
        names = np.array(digests, object)
        for batch in batches:
            kept, vectors = whole_vectors(batch.column("embedding"))
            best, distance, _ = nearest(vectors, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(kept)), pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(own[best], pa.int64()),
                 pa.array(np.full(len(kept), min(sum(inertia), largest)), pa.int64()), pa.array(names[best], pa.string())],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return assign


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """Cluster, squared distance, distance sums and centroid digest of every kept vector of ``embeddings`` (vec_id, embedding)."""
    vectors = embeddings.select("vec_id", "embedding")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    now = _start(vectors, centroids)
    if not len(now):
        # only vectors without an id, or none at all
        return embeddings.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for j, (n, _, sums) in _round(vectors.select("embedding"), now).items():
            now[j] = [s // n for s in sums]
    final = _round(vectors.select("embedding"), now)
    inertia = [final[j][1] if j in final else 0 for j in range(len(now))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    return vectors.mapInArrow(_assign(now, inertia, digests), schema)
