import hashlib

import numpy as np
import pytest

from lexspark.llm.hadamard import SIZE, cluster, nearest, transform
from lexspark.llm.queries import QUERIES
from lexspark.llm.sql import SQL

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string"


def brute(rows, centroids=40, rounds=5):
    """Plain rounds over (vec_id, components); returns cluster and distance by vec_id."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    vectors = np.floor(256 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64)
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(np.float32(v)), k) for k, (i, v) in enumerate(kept) if i is not None)
    c = vectors[[k for _, _, k in order[:centroids]]].copy()
    for _ in range(rounds):
        near = ((vectors[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = [s // int((near == j).sum()) for s in vectors[near == j].sum(0).tolist()]
    far = ((vectors[:, None] - c[None]) ** 2).sum(2)
    near, inertia = far.argmin(1), far.min(1)
    return sorted(
        (str(i), int(j), int(d), int(inertia[near == j].sum()), int(inertia.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
        for (i, _), j, d in zip(kept, near, inertia, strict=True)
    )


def rows_of(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("high", [2, 300, 2**27 - 1])
def test_search_equals_all_distances(high):
    draw = np.random.default_rng(high)
    centres = draw.integers(-high, high + 1, (40, SIZE))
    centres[9] = centres[4]
    near = centres[draw.integers(0, 40, 300)] + draw.integers(-1, 2, (300, SIZE))
    vectors = np.clip(np.vstack([near, draw.integers(-high, high + 1, (100, SIZE)), centres]), -(2**27) + 1, 2**27 - 1)
    got, distance, _ = nearest(vectors, centres)
    want = ((vectors[:, None].astype(object) - centres[None].astype(object)) ** 2).sum(2)
    assert got.tolist() == want.argmin(1).tolist() and distance.tolist() == want.min(1).tolist()


def test_transform_keeps_distances_and_search_leaves_work_out():
    draw = np.random.default_rng(1)
    x = draw.integers(-50, 50, (5, SIZE))
    assert ((transform(x) ** 2).sum(1) == SIZE * (x**2).sum(1)).all()
    centres = draw.integers(-200, 200, (40, SIZE))
    vectors = centres[draw.integers(0, 40, 500)] + draw.integers(-9, 10, (500, SIZE))
    assert nearest(vectors, centres)[2] < 0.25 * vectors.size * len(centres)


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op13_progressive_clusters"](spark, sf)) == brute(rows)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = con.execute(f"SELECT vec_id::VARCHAR, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({SQL['op13_progressive_clusters']})")
    assert sorted(got.fetchall()) == rows_of(QUERIES["op13_progressive_clusters"](spark, sf))


def test_odd_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i % 90, draw.normal(0, 2, SIZE).tolist()) for i in range(120)] + [(None, [0.25] * SIZE), (500, [3e5] * SIZE)]
    rows += [(7, rows[7][1])] * 3
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] * SIZE), (206, [1.0] * 63 + [float("inf")])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], SCHEMA)
    assert rows_of(cluster(df.repartition(5))) == brute(rows)


def test_few_and_no_vectors(spark):
    few = [(i, [float(i)] * SIZE) for i in range(3)]
    assert rows_of(cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in few], SCHEMA))) == brute(few)
    none = cluster(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(spark.createDataFrame([(None, [1.0] * SIZE, 1, "x")], SCHEMA)).count() == 0


def test_a_component_beyond_the_scale_is_held(spark):
    rows = [(0, [1e30] * SIZE), (1, [-1e30] * SIZE), (2, [0.0] * SIZE)]
    got = cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), centroids=1, rounds=0).collect()
    assert len(got) == 3 and max(r["distance"] for r in got) <= 2**63 - 1
