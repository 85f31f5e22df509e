"""What the quality model's dictionaries and curve are made of."""

import numpy as np

from larkspur.llm import quality


def test_dictionaries_hold_whole_texts_and_the_curve_the_rest(spark, monkeypatch):
    text = lambda i: f"row {i} begins {'Good words walk. ' if i % 2 else 'BAD | !! '}" + f"w{i % 7} " * (1500 if i % 3 else 30) + f"row {i} ends"
    texts = {i: text(i) for i in range(400)} | {400: "x" * 200_000, 401: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    used = []
    fitted = quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda x, y, ridge: used.append(len(y)) or fitted(x, y, ridge))
    fit = quality.Fit(held_out=-2, dictionary_bytes=60_000, shape_bytes=9_000)
    model = quality.train(docs, labels, fit)
    whole, shapes = {t.encode() for t in texts.values()}, {quality.shape_of(t.encode()) for t in texts.values()}
    raw = {y: d.split(b"\n") for y, d in model.raw.items()}
    assert all(set(parts) <= whole for parts in raw.values())
    assert all(set(d.split(b"\n")) <= shapes for d in model.shapes.values())
    assert all(40_000 < len(d) <= 60_000 for d in model.raw.values()) and all(4_000 < len(d) <= 9_000 for d in model.shapes.values())
    assert used == [len(texts) - sum(map(len, raw.values()))]


def test_texts_that_all_are_too_long_leave_dictionaries_empty(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'BAD'} {i} " * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.Fit(dictionary_bytes=10, shape_bytes=10))
    assert model.raw == {0: b"", 1: b""} and len(model.scores([b"text", b""])) == 2


def test_the_curve_is_the_least_of_its_loss():
    rng = np.random.default_rng(1)
    for seed in range(20):
        a = rng.normal(size=(600, 9)) * rng.uniform(0.5, 3, 9)
        i, j = np.triu_indices(9)
        b = np.clip(a, -6, 6)
        x = np.hstack([np.ones((len(a), 1)), b, b[:, i] * b[:, j]])
        y = (a[:, 0] + 0.5 * a[:, 1] + 0.3 * rng.normal(size=600) > 3).astype(float)
        w, keep = quality.logistic(x, y, 1e-5), 1e-5 * 600 + 1e-6
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -500, 500))) - y) + keep * w
        assert np.abs(slope).max() < 1e-3, seed


def test_the_score_never_falls_when_a_difference_grows_and_is_calibrated(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=500), 1)
    y, weight = (x + rng.normal(size=500) > 0).astype(float), np.where(rng.random(500) < 0.5, 1.0, 3.0)
    places, heights = quality.monotone(x, y, weight)
    assert (np.diff(places) > 0).all() and (np.diff(heights) >= 0).all() and 0 < heights.min() < heights.max() < 1
    # min-max form of the monotone fit, by brute force
    values = np.unique(x)
    mean = lambda a, b: np.average(y[(x >= a) & (x <= b)], weights=weight[(x >= a) & (x <= b)])
    for v in values[::5]:
        wanted = max(min(mean(a, b) for b in values[values >= v]) for a in values[values <= v])
        k = np.searchsorted(places, v)
        assert min(abs(wanted - h) for h in heights[max(0, k - 2) : k + 2]) < 0.05


def test_scores_are_those_of_sizes_by_hand_on_long_null_and_repeated_rows(spark):
    import zstandard

    rng = np.random.default_rng(3)
    words = ["stone", "river", "cloud", "light", "walks", "hills"]
    text = lambda i: " ".join(rng.choice(words, 60)) + "." if i % 2 else " | ".join(w.upper() + "!!" for w in rng.choice(words, 60))
    rows = [(i, text(i), "s") for i in range(500)] + [(7, text(1), "s"), (1000, "long text of stone " * 60_000, "s"), (1001, None, "s"), (None, "", "s"), (1002, "a" * 1024, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] * 2 + [(3, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.dictionaries["raw", 0] and (model.weights[1:] != 0).any()
    by = {k: zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None) for k, d in model.dictionaries.items()}

    def difference(kind, data, block):
        sizes = [sum(len(by[kind, q].compress(data[k : k + block])) for k in range(0, len(data), block)) for q in (0, 1)]
        return (sizes[0] - sizes[1]) / max(1, len(data))

    got = sorted((r.doc_id or -1, r.score) for r in quality.score(docs, model).collect())
    wanted = []
    for i, t, _ in rows:
        data = (t or "").encode()
        x = np.array([difference("raw", data, 1024), difference("shape", quality.shape_of(data), 128)])
        wanted.append((i or -1 if i != 0 else -1, float(np.interp((x - model.mean) / model.spread @ np.maximum(model.weights[1:], 0), model.knots, model.heights))))
    assert np.allclose([s for _, s in got], [s for _, s in sorted(wanted)])
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
