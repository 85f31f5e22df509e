"""Neighbours among many equal vectors."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm.neighbours import copies, nearest


def test_copies_do_not_push_nearer_rows_out(spark, monkeypatch):
    monkeypatch.setattr("larkspur.llm.neighbours.WORDS", 16)  # coarse, so that shortlists matter
    rng = np.random.default_rng(5)
    n, dim = 2400, 16
    x = rng.normal(size=(n, dim)).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(unit @ unit[7]))[1:101]  # the queries: rows around the one that is copied
    rows = [(i, v.tolist(), bool(i in set(near))) for i, v in enumerate(x)] + [(n + i, x[7].tolist(), False) for i in range(n // 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q boolean").coalesce(1)
    full = np.vstack([x, np.repeat(x[7:8], n // 2, 0)]).astype(float)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    hits = 0
    got = nearest(df, F.col("q")).collect()
    for q in near:
        score = (full * full[q]).sum(1)
        score[q] = -9
        best = np.lexsort((np.arange(len(full)), -score))[:5]
        hits += len(set(best) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (5 * len(near)) >= 0.97


def test_rows_that_stand_for_a_vector():
    unit = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, -0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.6, 0.8]])
    rows, begin, count = copies(unit, np.array([1, 2, 3, 3, 3, 4, 5]), 2)
    assert [rows[b : b + c].tolist() for b, c in zip(begin, count, strict=True)] == [[0, 2, 3, 4, 5], [1], [6]]
