import math

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm.neighbours import encode, fit, nearest, shortlist

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def test_recall_and_scores(spark):
    x = clustered(1500)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)
    got = nearest(df, F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, len(x), 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], score[[m[1] for m in mine]], atol=1e-12, rtol=0)
        hits += len(set(best) & {m[1] for m in mine})
        total += 5
    assert hits / total >= 0.9


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0], 0, 0) for i in range(1, 40)]
    rows += [(0, [1.0, 2.0], 0, 0), (100, [0.0, 0.0], 0, 0), (150, None, 0, 0), (200, [math.nan, 1.0], 0, 0), (250, [None, 1.0], 0, 0), (300, [math.inf, 1.0], 0, 0), (350, [1.0, 2.0, 3.0], 0, 0), (None, [1.0, 2.0], 0, 0)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, k, k) for k in range(1, 6)]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [1.0, 1.0], 0, 0), (2, [0.0, 1.0], 0, 0)], SCHEMA)
    assert [(r.rank, r.vec_id) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert nearest(df, F.col("vec_id") == 77).count() == 0


def test_beam_search_beats_the_greedy_way():
    x = clustered(800)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = fit(x)
    error = lambda beam: ((encode(x, books, beam)[1] - x) ** 2).sum()
    codes, sums = encode(x, books)
    assert error(4) <= error(1)
    assert np.allclose(sums, sum(books[m][codes[:, m]] for m in range(len(books))), atol=1e-4)


def test_shortlist_ties_go_to_smaller_numbers():
    (got,) = shortlist(np.array([[1.0, 3.0, 1.0, 1.0, 2.0]]), 3)
    assert sorted(got.tolist()) == [0, 1, 4]
