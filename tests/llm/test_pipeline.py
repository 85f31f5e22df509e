"""Every stage of the pipeline against what it has to do, and the registered queries."""

from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


def without_near_copies(docs):
    """The smallest id of each group of texts linked at 0.8 over five-word shingles."""
    sets = {}
    for i, text in docs.items():
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def without_repeats(docs, span=20):
    """The words left in each text; texts that lost all of theirs are gone."""
    seen, out = set(), {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        gone = set()
        for k in range(len(w) - span + 1):
            window = tuple(w[k : k + span])
            if window in seen:
                gone.update(range(k, k + span))
            seen.add(window)
        if not w or len(gone) < len(w):
            out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, tmp_path):
    """Each stage by brute force on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    now = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        before, rows = now, docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in rows}
        if name == "quality":
            assert sum(i in now for i, q in labels.items() if q) >= 0.95 * sum(labels.values())
            assert sum(i in now for i, q in labels.items() if not q) <= 0.3 * sum(not q for q in labels.values())
            assert all(before[i] == t for i, t in now.items())
        elif name == "near_duplicates":
            assert set(now) == without_near_copies(before) and len(now) < len(before)
        elif name == "repeated_passages":
            assert {i: (t or "").encode().split() for i, t in now.items()} == without_repeats(before)
            assert all(r.n_chars == len(r.text) for r in rows) and now != before
        elif name == "mixing":
            assert set(now) == set(before) and len(rows) > len(before)
    assert {r.doc_id for r in rows} == set(before)
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024 and sum(filled.values()) >= 0.9 * 1024 * len(filled)


def test_run_is_the_stages_one_after_another(spark):
    out = __spark_entry__.queries()["pipeline"](spark, str(DATA))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
