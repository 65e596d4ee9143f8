from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import multi_index
from tablewright.llm.multi_index import learn_codes, nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def exact(rows, every, k):
    kept = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted(i for i in kept if i % every == 0):
        near = sorted((float(np.sqrt(((kept[q] - x) ** 2).sum())), i) for i, x in kept.items() if i != q)[:k]
        out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    return out


def test_edges_ties_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(12)] + [(i, [1.0] * 8, None) for i in range(20, 50)]
    rows += [(60, None, "x"), (61, [0.0] * 8, "x"), (62, [1.0] * 7 + [math.nan], "x"), (63, [1.0, None] * 4, "x"), (64, [1.0] * 5, "x"), (65, [], "x"), (66, [math.inf] * 8, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = nearest(df, F.col("vec_id") % 10 == 0, neighbours=5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())
    want = exact(rows, 10, 5)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert len(set(got) & set(want)) / len(want) >= 0.9  # equal vectors and their ids are exact
    assert [g for g in got if g[0] in (20, 30, 40)] == [w for w in want if w[0] in (20, 30, 40)]
    few = nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert [(r["rank"], r.vec_id) for r in few.orderBy("rank").collect()] == [(w[1], w[2]) for w in exact(rows[:3], 10, 10)]
    for empty in (df.limit(0), df.filter("vec_id = 61"), df.filter("vec_id = 0")):
        assert nearest(empty, F.col("vec_id") == 0).count() == 0


def test_each_length_is_searched(spark):
    rows = [(1, [1.0, 0.0, 0.0], None), (2, [1.0, 1.0, 0.0], None), (3, [0.0, 0.0, 5.0], None), (4, [3.0, 0.0], None), (10, [3.0, 4.0], None), (20, [3.0, 1.0], None), (30, [7.0], None)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == [(10, 1, 20, 3.0), (10, 2, 4, 4.0), (20, 1, 4, 1.0), (20, 2, 10, 3.0)]


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=8)).tolist(), None) for i in range(1500)]
    found = {(r.query_id, r.vec_id) for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()}
    want = {(q, i) for q, _, i, _ in exact(rows, 50, 10)}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_substring_limits_cover_the_radius():
    codes = learn_codes(np.random.default_rng(3).normal(size=(50, 64)), 3)
    assert sum(bin(m).count("1") for m in codes.masks) == 64
    for radius in range(65):
        assert sum(limit + 1 for limit in codes.limits(radius)) == radius + 1  # more differing bits than that exceed every limit only beyond it


def test_no_broadcast_grows_with_the_probes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, None) for i, v in enumerate(rng.normal(size=(3000, 64)).tolist())]
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "128MB")  # 600 queries probe more values than that; a page alone may take 64 MB
    try:
        found = [(r.query_id, r.vec_id) for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect()]
    finally:
        spark.conf.unset(limit)
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    want = {(q, int(i)) for q in range(0, 3000, 5) for i in np.argsort(((x[q] - x) ** 2).sum(1))[1:11]}
    assert len(found) == len(want) and len(want & set(found)) >= 0.9 * len(want)


def test_an_index_meets_all_within_its_limits_and_no_others():
    x = np.random.default_rng(5).normal(size=(700, 20))
    codes = learn_codes(x, 5)
    code = codes.of(x)[0]
    for radius in (0, 3, 7, codes.bits):
        limits = codes.limits(radius)
        index = multi_index._Index(codes, limits, code)
        for own in code[:20].tolist():
            want = [any(((c ^ own) & mask).bit_count() <= most for mask, most in zip(codes.masks, limits)) for c in code.tolist()]
            assert index.met(own).tolist() == want
            assert all(w for w, c in zip(want, code.tolist()) if (c ^ own).bit_count() <= radius)


def test_blocks_of_any_size_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v, None) for i, v in enumerate(rng.normal(size=(400, 16)).tolist())]
    rows += [(i + 1000, v, None) for i, v, _ in rows[:40]] + [(i, [9.0 - x for x in v], None) for i, v, _ in rows[30:60]] + [(None, [0.5] * 16, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def found():
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 10 == 0).collect())

    whole = found()
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 8 * 16 * 7)
    monkeypatch.setattr(multi_index, "ASKED_BYTES", 8 * 16 * 3)
    assert found() == whole


def test_the_sample_is_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SAMPLE", 50)
    ids = [*range(300), *[7] * 20, None]
    df = spark.createDataFrame([(i, np.array([float(n)]).tobytes()) for n, i in enumerate(ids)], "vec_id long, x binary").repartition(5)
    want = [np.frombuffer(r.x)[0] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(50).collect()]
    assert multi_index._sample(df)[:, 0].tolist() == want
