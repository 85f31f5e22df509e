"""Ways for hot keys give what the others give; components of long chains; lengths dealt over salts."""

import random

import public_tokenizers
import pytest

from larkspur.llm import hot, jaccard, packing, phrases
from larkspur.llm.components import connected
from larkspur.llm.scratch import Scratch


@pytest.fixture
def texts(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("stone river cloud light walks hills early spring of the and over".split())
    footer = " ".join(word() for _ in range(26))
    rows = []
    for i in range(150):
        body = [word() + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60))]
        if i % 5 == 0 and rows:
            body = (rows[-1][1] or "").split()
            body[:1] = ["changed"]
        rows.append((i, " ".join(body) + (" " + footer if i % 3 else "")))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_hot_and_other_keys_give_the_same(spark, texts, monkeypatch):
    run = lambda: (sorted(map(tuple, jaccard.near_duplicates(texts, n=4, num=85).collect())), sorted(map(tuple, phrases.repeated_phrases(texts).collect())))
    plain = run()
    for name, value in (("SAMPLED", 1), ("HOT", 10**9), ("LEAST", 1)):  # every key that two texts have is hot
        monkeypatch.setattr(hot, name, value)
    counted = []
    found = hot.hot_keys
    for module in (jaccard, phrases):
        monkeypatch.setattr(module, "hot_keys", lambda *args: counted.append(found(*args)) or counted[-1])
    assert run() == plain
    assert len(counted) == 2 and all(c.count() > 10 for c in counted)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    writes = []
    put = Scratch._put
    monkeypatch.setattr(Scratch, "_put", lambda self, df, path: writes.append(path) or put(self, df, path))
    with Scratch(spark) as s:
        got = {r.node: r.root for r in connected(s, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(401), 0), 1000: 1000, 1001: 1000}
    assert len(writes) < 50


def test_lengths_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 7)
    docs = spark.createDataFrame([(i, "word " * (i % 9) * 100) for i in range(120)] + [(5, "word"), (None, "word"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
