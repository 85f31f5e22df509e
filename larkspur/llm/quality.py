"""Quality by compression: zstandard dictionaries trained on good and on bad labelled text.

A text is compressed block by block with the dictionary of good text and with that of bad text, as it is and as its
shape (runs of lower-case letters, capitals and digits put as one sign each, marks kept). Blocks start afresh, so the
dictionaries matter all along a long text. Two numbers come of it, for the text and for its shape: the difference of the
compressed sizes, bad minus good, normalised by length. A logistic curve weighs them (weights are 0 at least), and a
monotone step fit calibrates their weighted sum: a score in 0..1 that never falls when a difference grows, higher for
label 1. Steps are joined as the curve runs; straight lines would give a text in a wide gap between the labels about 1/2,
wherever in it the curve turns. Nothing else of the text enters the score.

Fitting reads a bounded sample of labelled rows, ``Fit.dictionary_rows`` and ``Fit.curve_rows`` together of each label,
in the order of a hash of the id. The dictionaries, of ``Fit.raw_size`` and ``Fit.shape_size`` bytes, are trained on whole
texts: of the first ``Fit.dictionary_rows`` (at most half of a label's rows) those that still fit ``Fit.dictionary_bytes``,
and for shapes those of them that still fit ``Fit.shape_bytes``. All other rows go to the curve, so its rows never are the
dictionaries' rows; there labels weigh as they are frequent among all labelled rows. Scoring covers every row and whole texts.

Null text counts as empty and gets the curve's value at difference 0. Rows without id never count as held out. A label
row that is null is left out, contradicting labels of one id count as the lower one, a repeated row counts once. With no
rows of one label every score is the share of label 1 (1/2 without any). With too little text for a dictionary there is
none. Other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import map_arrow, map_batches, utf8
from larkspur.llm.scratch import Scratch

LEVEL = 3
#: Bytes of a text, and of its shape, that are compressed at a time.
BLOCK, SHAPE_BLOCK = 1024, 128
_shape = bytearray(range(256))
_shape[97:123] = b"a" * 26
_shape[65:91] = b"A" * 26
_shape[48:58] = b"0" * 10
_shape[128:256] = b"a" * 128
SHAPE = bytes(_shape)


@dataclass(frozen=True)
class Fit:
    """Bounds of what is read to fit a model."""

    dictionary_rows: int = 1000
    dictionary_bytes: int = 1 << 21
    shape_bytes: int = 1 << 20
    raw_size: int = 1 << 16
    shape_size: int = 1 << 14
    curve_rows: int = 4000
    ridge: float = 1e-5
    folds: int = 5
    held_out: int = 0


def shape_of(text: bytes) -> bytes:
    return re.sub(rb"A{2,}", b"AA", re.sub(rb"a{2,}", b"a", text.translate(SHAPE)))


def trained(text: bytes, size: int, block: int) -> bytes:
    """A dictionary of ``text``, empty if there isn't enough of it to make one."""
    try:
        return zstandard.train_dictionary(size, [text[k : k + block] for k in range(0, len(text), block)]).as_bytes() if text else b""
    except zstandard.ZstdError:
        return b""


def compressed(by: zstandard.ZstdCompressor, text: bytes, block: int) -> int:
    return sum(len(by.compress(text[k : k + block])) for k in range(0, len(text), block))


@dataclass
class Model:
    """Dictionaries and curve; what it was trained on stays behind when it travels with a task."""

    raw: dict[int, bytes] = field(default_factory=dict)
    shapes: dict[int, bytes] = field(default_factory=dict)
    dictionaries: dict[tuple[str, int], bytes] = field(default_factory=dict)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    heights: np.ndarray | None = None
    prior: float = 0.5

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_by"} | {"raw": {}, "shapes": {}}

    def train_dictionaries(self, fit: Fit) -> None:
        for kind, held, size, block in (("raw", self.raw, fit.raw_size, BLOCK), ("shape", self.shapes, fit.shape_size, SHAPE_BLOCK)):
            self.dictionaries |= {(kind, q): trained(text, size, block) for q, text in held.items()}

    def _compressors(self) -> dict:
        if not hasattr(self, "_by"):
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
            self._by = {k: make(d) for k, d in self.dictionaries.items()}
        return self._by

    def features(self, text: bytes) -> list[float]:
        """The normalised differences of the text and of its shape."""
        by, shape = self._compressors(), shape_of(text)
        less = lambda kind, x, block: (compressed(by[kind, 0], x, block) - compressed(by[kind, 1], x, block)) / max(1, len(x))
        return [less("raw", text, BLOCK), less("shape", shape, SHAPE_BLOCK)]

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ np.maximum(self.weights[1:], 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.place(np.array([self.features(t) for t in texts]).reshape(-1, 2)), self.knots, self.heights)


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, heights) of the steps of the weighted least-squares fit of ``y`` that never falls along ``x``.

    A step's height counts half a row of each kind besides its own, so that none is 0 or 1.
    """
    blocks: list[list[float]] = []  # mean place, mean height, weight, rows
    for value in np.unique(x):
        at = x == value
        blocks.append([float(value), float(np.average(y[at], weights=weight[at])), float(weight[at].sum()), int(at.sum())])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            (x1, y1, w1, n1), (x0, y0, w0, n0) = blocks.pop(), blocks.pop()
            blocks.append([(x0 * w0 + x1 * w1) / (w0 + w1), (y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    places, heights, _, rows = np.array(blocks).T
    return places, np.maximum.accumulate((heights * rows + 0.5) / (rows + 1))


#: Logits at which the curve between two steps has a knot.
LOGITS = np.arange(-48, 49) / 4


def joined(places: np.ndarray, heights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The steps with knots between them, so that lines rise as the logistic curve of place + ``bias`` does."""
    curve = lambda at: 1 / (1 + np.exp(-np.clip(at + bias, -700, 700)))
    between = np.setdiff1d(LOGITS - bias, places)
    between = between[(between > places[0]) & (between < places[-1])]
    rising = np.interp(curve(between), curve(places), heights)
    order = np.argsort(np.append(places, between))
    return np.append(places, between)[order], np.append(heights, rising)[order]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w, keep = np.zeros(x.shape[1]), ridge * len(y) + 1e-6
    loss = lambda w: (np.logaddexp(0, z := x @ w) - y * z).sum() + keep / 2 * (w @ w)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep * np.eye(len(w)), x.T @ (p - y) + keep * w)
        # a full Newton step may overshoot for good where the classes come apart
        part = next((a for a in 0.5 ** np.arange(30) if loss(w - a * step) <= loss(w)), 0.0)
        w = w - part * step
        if not part or np.abs(step).max() < 1e-9:
            break
    return w


def fitting(sizes: list[int], most: int) -> list[int]:
    """The numbers of the sizes, taken in order, that with a line break between two still fit ``most``."""
    taken, end = [], -1
    for i, size in enumerate(sizes):
        if end + 1 + size <= most:
            taken.append(i)
            end += 1 + size
    return taken


def fold(id_col: str, fit: Fit) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fit.folds, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labelled rows that aren't held out; reads ``docs`` once."""
    spark, order = docs.sparkSession, F.xxhash64(F.col("id"), F.lit(7))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("y").alias("y"))
    known = known.filter(fold("id", fit) != fit.held_out)
    kind = known.schema["id"].dataType.simpleString()
    most = fit.dictionary_rows + fit.curve_rows
    with Scratch(spark) as s:
        known = s.write(known.withColumn("h", order))
        counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
        if len(counts) < 2:
            return Model(prior=float(next(iter(counts), 0.5)))
        prior = counts[1] / sum(counts.values())
        # at most 2 * most rows, which may be broadcast; the first dictionary_rows of a label, or half of them, are candidates
        picked = [known.filter(F.col("y") == y).orderBy("h", "id").limit(most) for y in (0, 1)]
        picked = sorted(picked[0].unionByName(picked[1]).collect(), key=lambda r: (r["y"], r["h"], r["id"]))
        take = {y: max(1, min(fit.dictionary_rows, min(n, most) // 2)) for y, n in counts.items()}
        begin = {0: 0, 1: sum(r["y"] == 0 for r in picked)}
        ids = spark.createDataFrame([(r["id"], r["y"], k, k - begin[r["y"]] < take[r["y"]]) for k, r in enumerate(picked)], f"id {kind}, y int, k int, candidate boolean")
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        sample = s.write(texts.join(F.broadcast(ids), "id"))
        # of the candidates the texts that fit, by the size of all rows with the id
        sizes = sorted(sample.filter("candidate").groupBy("y", "k").agg(F.sum(F.octet_length("text") + 1).alias("size")).collect())
        chosen = []
        for y in (0, 1):
            own = [r for r in sizes if r["y"] == y]
            chosen += [own[i]["k"] for i in fitting([r["size"] - 1 for r in own], fit.dictionary_bytes)]
        first = spark.createDataFrame([(k,) for k in chosen], "k int")
        parts = sample.join(F.broadcast(first), "k").select("y", "k", "text").collect()
        parts = {y: [r["text"].encode() for r in sorted((r for r in parts if r["y"] == y), key=lambda r: (r["k"], r["text"]))] for y in (0, 1)}
        model = Model(raw={y: b"\n".join(p) for y, p in parts.items()}, prior=prior)
        for y, p in parts.items():
            shapes = [shape_of(t) for t in p]
            model.shapes[y] = b"\n".join(shapes[i] for i in fitting([len(t) for t in shapes], fit.shape_bytes))
        model.train_dictionaries(fit)

        def of_batch(batch: pa.RecordBatch) -> dict:
            return {"k": batch.column(0), "y": batch.column(1), "x": [[float(v) for v in model.features(t or b"")] for t in utf8(batch.column(2))]}

        rest = map_batches(sample.join(F.broadcast(first), "k", "left_anti").select("k", "y", "text"), of_batch, "k int, y int, x array<double>").collect()
    rest.sort(key=lambda r: (r["k"], r["x"]))
    y = np.array([r["y"] for r in rest], float)
    if len(set(y)) < 2:
        return Model(prior=prior)
    x = np.array([r["x"] for r in rest])
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic(np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.spread]), y, fit.ridge)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    model.knots, model.heights = joined(*monotone(model.place(x), y, weight), model.weights[0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()) -> DataFrame:
    """``id_col``, held_out and score of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "held_out": batch.column(1), "score": model.scores([t or b"" for t in utf8(batch.column(2))])}

    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, fit) == fit.held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of_batch, f"id {kind}, held_out boolean, score double").withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.scores([t or b"" for t in utf8(batch.column(text_col))]) >= least))

    return map_arrow(docs, keep, docs.schema)
