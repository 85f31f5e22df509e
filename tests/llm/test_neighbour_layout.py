"""Results don't depend on how rows lie in tasks."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm.neighbours import nearest


def test_equal_rows_in_one_part_and_in_many(spark, monkeypatch):
    for name, value in (("WORDS", 16), ("BOOKS", 4), ("SHORT", 12), ("ROW_BLOCK", 100), ("PAIRS", 50)):  # coarse, so that shortlists matter
        monkeypatch.setattr(f"larkspur.llm.neighbours.{name}", value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:420] = x[5]
    x[420:440] = 2 * x[5]
    rows = [(i % 880, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 20 == 0
    results = [sorted(map(tuple, nearest(d, is_query).collect())) for d in (df.coalesce(1), df.repartition(24), df.orderBy(F.desc("vec_id")).coalesce(3))]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 5 * len({r[0] for r in results[0]})
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by_id = {}
    for (i, _), u in zip(rows, unit, strict=True):
        by_id.setdefault(i, []).append(u)
    for q, _, i, score in results[0]:
        assert i != q and any(abs(a @ b - score) < 1e-12 for a in by_id[q] for b in by_id[i])
