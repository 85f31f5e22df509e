"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from larkspur.llm.jaccard import Forest, Tree, bands, bitmap, near_duplicates, signatures
from larkspur.llm.words import U, hashed_texts, shingles

SCHEMA = "doc_id long, text string, lang string, component_id long, node long"


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w[: len(w) - rng.choice([0, 0, rng.randint(0, len(w) // 4)])]))
    return [*out, None, "  \t", "A b C", "a B c", "É"]


def truth(texts, n, num, den):
    def words(t):
        return "".join(c.lower() if c.isascii() else c for c in t or "").split(" ")

    sets = []
    for t in texts:
        w = [x for x in words((t or "").replace("\t", " ")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    forest = Forest(len(texts))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and den * both >= num * len(x | sets[j]):
                forest.join(i, j)
    return {i: (len(x), forest.find(i)) for i, x in enumerate(sets)}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_all_pairs(spark, n, num, den):
    texts = made(n)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, n, num, den).collect()}
    assert got == truth(texts, n, num, den)


def test_blocks_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr("larkspur.llm.jaccard.BLOCK_TOKENS", 60)
    monkeypatch.setattr("larkspur.llm.jaccard.BUCKET_TOKENS", 100)
    texts = made(9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 4, 80, 100).collect()}
    assert got == truth(texts, 4, 80, 100)


def test_copies_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (3, text), (3, text), (9, text.upper()), (None, text), (1, ""), (2, "")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id) for r in near_duplicates(df, 4, 85, 100).collect())
    assert rows == [(1, 1), (2, 2), (3, 3), (3, 3), (5, 3), (9, 3)]


def test_empty_table(spark):
    out = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "rep"] and out.count() == 0


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(U))
        gone = int(rng.integers(0, max(1, n * (den - num) // den + 1)))
        y = np.unique(np.concatenate([x[gone // 2 :], rng.integers(0, 1 << 63, gone - gone // 2).astype(U)]))
        both = len(np.intersect1d(x, y))
        if both and den * both >= num * (len(x) + len(y) - both):
            assert set(signatures(x, num, den)) & set(signatures(y, num, den))


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, 60).astype(U)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[k:], rng.integers(0, 1 << 63, k).astype(U)])) for b in base for k in range(12)]
    found = Forest(len(sets))
    link = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    Tree([len(s) for s in sets], [bitmap(s) for s in sets], 80, 100, link).links(found)
    pairs = Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if link(i, j):
                pairs.join(i, j)
    assert [found.find(i) for i in range(len(sets))] == [pairs.find(i) for i in range(len(sets))]


def test_long_texts_are_taken_whole():
    text = ("alpha beta gamma delta " * 400_000).encode()
    ((_, words),) = hashed_texts([text])
    assert len(words) == 1_600_000 and len(shingles(words, 4)) == 4
    assert bands(85, 100).of(1_600_000) > 0
