"""Substring dedup against the definition."""

import hashlib
import random

import pytest

from larkspur.llm.phrases import repeated_phrases


def truth(docs, span=20):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - span + 1):
            window = tuple(w[k : k + span])
            if window in seen:
                gone.update(range(k, k + span))
            seen.add(window)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(20, 60))) for _ in range(4)]
    docs = []
    for i in range(n):
        fill = lambda: " ".join(rng.choice(["h", "i", "j", "k", "ü", "K"]) for _ in range(rng.randint(0, 30)))
        docs.append((i, f"{fill()} {rng.choice(passages)}\n{fill()}\t{rng.choice(passages)[10:]} {fill()}"))
    docs += [(n, None), (n + 1, ""), (n + 2, "x " * 200), (n + 3, "x " * 50), (n + 4, "y y z " * 40), (n + 5, docs[3][1]), (n + 6, docs[3][1]), (n + 7, "short text"), (n + 8, "short text")]
    return docs


@pytest.mark.parametrize(("span", "batch", "often"), [(20, 8000, 1000), (20, 3, 1000), (8, 5, 1000), (20, 8000, 0), (8, 4, 3)])
def test_definition(spark, span, batch, often):
    docs = made(span + batch)
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id long, text string, start int, h string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_phrases(df, span=span, batch_rows=batch, often=often).collect()}
    assert got == truth(docs, span)


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(1, f"one  two\n{passage} three"), (2, f"four {passage} five  six"), (3, "nothing here")]
    rows = {r.doc_id: r.kept_text for r in repeated_phrases(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()}
    assert rows == {1: None, 2: "four\nfive  six", 3: None}


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"p{i}" for i in range(30))
    rows = repeated_phrases(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 30)]


def test_empty_table_and_bad_span(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_phrases(empty).count() == 0
    with pytest.raises(ValueError, match="span"):
        repeated_phrases(empty, span=3)
